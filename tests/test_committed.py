"""Two-phase appends: failed tasks, failed jobs, repeated batches, replacement; and the operators of the study's audits."""

import subprocess
import sys
import textwrap
from pathlib import Path

import pytest
from pyspark.sql import Row

from stillwater.operators import checks, metrics, selection, thresholds
from stillwater.sources import committed, readers

ROOT = str(Path(__file__).resolve().parent.parent)


def test_batches_are_seen_once(spark, tmp_path):
    path, rows = str(tmp_path / "log"), spark.range(100).withColumnRenamed("id", "k")
    assert committed.read(spark, path, rows.schema).count() == 0
    for _ in range(3):
        committed.write(rows.where("k < 40"), path, "a")
    committed.write(rows.where("k >= 40"), path, "b")
    assert sorted(r.k for r in committed.read(spark, path, rows.schema).collect()) == list(range(100))
    # what a repeated batch wrote is deleted again
    held = sum(len(m["files"]) for m in committed._manifests(*committed._store(path)).values())
    assert len(list((tmp_path / "log" / "data").iterdir())) == held


def test_replacement_is_one_move(spark, tmp_path):
    path, rows = str(tmp_path / "log"), spark.range(10)
    committed.write(rows, path, "a")
    committed.write(rows.where("id < 3"), path, "b", overwrite=True)
    committed.write(rows.where("id = 9"), path, "c")
    assert sorted(r.id for r in committed.read(spark, path, rows.schema).collect()) == [0, 1, 2, 9]
    committed.write(rows, path, "a")  # known, though replaced
    assert committed.read(spark, path, rows.schema).count() == 4
    with pytest.raises(Exception, match="a batch is named"):
        committed.write(rows, path, "../x")


def test_lost_attempts_are_never_read(spark, tmp_path):
    path, rows = str(tmp_path / "log"), spark.range(10)
    committed.write(rows, path, "a")
    first = next((tmp_path / "log" / "data").glob("*.parquet"))
    (tmp_path / "log" / "data" / "a-lost.parquet").write_bytes(first.read_bytes())
    (tmp_path / "log" / "manifests" / "half.part").write_text('{"files": [')
    assert committed.read(spark, path, rows.schema).count() == 10


def test_failed_task_is_tried_again_and_failed_job_leaves_nothing(tmp_path):
    """A task fails once and its second attempt counts; a job whose task fails for good is not seen; then it is repeated."""
    code = textwrap.dedent(f"""
        import os, sys
        sys.path.insert(0, {ROOT!r})
        os.environ["PYTHONPATH"] = {ROOT!r}
        from pyspark.sql import SparkSession
        from stillwater.sources import committed
        spark = SparkSession.builder.master("local[2,2]").config("spark.ui.enabled", "false").getOrCreate()
        spark.sparkContext.setLogLevel("OFF")
        path, flag = {str(tmp_path / "log")!r}, {str(tmp_path / "flag")!r}
        def frail(always):
            def run(batches):
                for batch in batches:
                    yield batch
                if always or not os.path.exists(flag):
                    open(flag, "w").close()
                    raise RuntimeError("lost")
            return run
        rows = spark.range(0, 1000, 1, 2)
        committed.write(rows.mapInArrow(frail(False), "id long"), path, "a")
        print(committed.read(spark, path, rows.schema).count())
        try:
            committed.write(rows.mapInArrow(frail(True), "id long"), path, "b")
        except Exception:
            print("failed", committed.read(spark, path, rows.schema).count())
        for _ in range(2):
            committed.write(rows, path, "b")
        print(committed.read(spark, path, rows.schema).count())
    """)
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=300, check=True)
    assert out.stdout.split() == ["1000", "failed", "1000", "2000"]


def test_files_are_found_at_any_depth(spark, tmp_path):
    for name, size in (("a/x.mp4", 3), ("a/b/c/y.mp4", 5), ("ab/z.mp4", 7), ("a/note.txt", 9), ("w.mp4", 0)):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(b"." * size)
    root = str(tmp_path)
    assert sorted((r.subgroup, r.length) for r in readers.discovered(spark, root, "*.mp4").collect()) == [(".", 3), (".", 5), (".", 7)]
    assert sorted((r.subgroup, r.length) for r in readers.discovered(spark, root, "*.mp4", ["a", "ab"]).collect()) == [("a", 3), ("a", 5), ("ab", 7)]
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        readers.discovered(spark, root, "*.mp4", ["a", "none"]).collect()


def test_largest_takes_the_first_of_ties(spark):
    rows = spark.createDataFrame([("a", 3, 2), ("a", 1, 5), ("a", 2, 5), ("b", 9, 0), ("c", 4, None)], "k string, place int, size int")
    got = {(r.k, r.place, r.size) for r in selection.largest(rows, ["k"], "size", "place").collect()}
    assert got == {("a", 1, 5), ("b", 9, 0), ("c", 4, None)}


def test_scored_subset(spark):
    rows = spark.createDataFrame([(1, " 0.5 ", "True"), (2, "", "yes"), (3, "NULL", "1"), (4, "0.25", None), (5, None, "y"), (6, "1", "no"), (7, "0", " Y ")], "id int, score string, score_available string")
    assert sorted((r.id, r.score) for r in selection.scored(rows).collect()) == [(1, 0.5), (7, 0.0)]
    assert sorted(r.id for r in selection.scored(rows.drop("score_available")).collect()) == [1, 4, 6, 7]
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        selection.scored(spark.createDataFrame([("n/a", "1")], "score string, score_available string")).collect()


def test_wrong_decisions(spark):
    rows = spark.createDataFrame([(1, 0.5, 0.5, 1), (2, 0.4, 0.5, 1), (3, None, 0.5, None), (4, None, 0.5, 0), (5, 0.9, 0.5, None)], "id int, video_score double, threshold_value double, decision int")
    assert sorted((r.id, r.stated, r.computed) for r in checks.wrong_decisions(rows, ["id"]).collect()) == [(2, 1, 0), (4, 0, None), (5, None, 1)]


def test_identities(spark):
    rows = spark.createDataFrame([Row(v=1, role="a", sub=None, pos=0), Row(v=1, role="a", sub="", pos=1), Row(v=2, role="a", sub="x", pos=0), Row(v=2, role="b", sub=None, pos=0)], "v int, role string, sub string, pos int")
    assert sorted((r.v, r.rule) for r in checks.identities(rows, ["v"], ["role", "sub"], "pos").collect()) == [(2, "pos"), (2, "role"), (2, "sub")]


def test_false_positives_and_row_means(spark):
    real = spark.createDataFrame([("d", 0.5, 0.5), ("d", 0.4, 0.5), ("e", 0.1, 0.5)], "k string, s double, t double")
    assert sorted(map(tuple, thresholds.false_positives(real, ["k"], "s", "t").collect())) == [("d", 1, 2, 0.5), ("e", 0, 1, 0.0)]
    wide = spark.createDataFrame([(1.0, None, 3.0), (None, None, None)], "a double, b double, c double")
    assert [r["mean"] for r in metrics.with_row_mean(wide, ["a", "b", "c"]).collect()] == [2.0, None]
