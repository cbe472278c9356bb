"""Reconciliation, audits, curves on a grid, case lists and numbered lines against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from stillwater.operators import audit, metrics, reconcile, selection
from stillwater.sources import readers


def test_all_kinds_of_presence(spark):
    """Seven sets of tables that may have a key, null keys, repeats, and fields that differ, null and not."""
    names, sides = ["a", "b", "c"], {n: [] for n in ("a", "b", "c")}
    for mask in range(1, 8):
        for k, n in enumerate(names):
            if mask >> k & 1:
                sides[n].append((mask, "x", 1))
    sides["a"] += [(None, "x", 1), (20, "x", 1), (21, None, 1), (22, "x", None), (7, "x", 1)]
    sides["b"] += [(None, "y", 1), (20, "x", 1), (21, "x", 1), (22, "x", None)]
    sides["c"] += [(None, "x", 1), (20, "x", 1), (21, "x", 1), (22, "x", None)]
    tables = {n: spark.createDataFrame(rows, "id int, text string, n int") for n, rows in sides.items()}
    tables["c"] = tables["c"].drop("n")  # a table without a field takes no part in its comparison
    got = {r["id"]: (r["missing"], r["repeated"], r["differing"]) for r in reconcile.reconciled(tables, ["id"], ["text", "n"]).collect()}
    want = {mask: ([n for k, n in enumerate(names) if not mask >> k & 1], [], []) for mask in range(1, 7)}
    want |= {7: ([], ["a"], []), None: ([], [], ["text"]), 21: ([], [], ["text"])}
    assert got == want
    assert reconcile.reconciled({n: t.limit(0) for n, t in tables.items()}, ["id"], ["text"]).count() == 0


def test_rules_are_counted_while_writing(spark, tmp_path):
    found = audit.Audit(spark)
    df = spark.createDataFrame([(k, None if k % 5 == 0 else k) for k in range(20)], "id int, v int")
    back = found.written(df, str(tmp_path / "a"), {"known": "v IS NOT NULL", "small": "v < 18", "any": "id >= 0"})
    found.keyed(back, ["v"], {"n": F.count("*")}, {"once": "n = 1"})
    assert back.count() == 20 and found.scans == 2
    assert [tuple(r) for r in found.table().collect()] == [("known", 20, 4, False), ("small", 20, 6, False), ("any", 20, 0, True), ("once", 17, 1, False)]


def test_digest_and_chain(spark):
    df = spark.createDataFrame([(1, "a"), (2, None), (2, None)], "id int, t string")
    assert audit.digest(df, ["id", "t"]) == audit.digest(df.repartition(3).orderBy("t"), ["id", "t"]) != audit.digest(df.distinct(), ["id", "t"])
    assert audit.digest(df.limit(0), ["id", "t"]) == (0, 0)
    links = [{"name": "a", "rows": 1, "digest": 5, "source": None, "stated": None}, {"name": "b", "rows": 1, "digest": 6, "source": "a", "stated": 5}, {"name": "c", "rows": 1, "digest": 7, "source": "b", "stated": 5}, {"name": "d", "rows": 1, "digest": 7, "source": "gone", "stated": 5}]
    assert {r["name"]: r["link_ok"] for r in audit.chain(links, spark).collect()} == {"a": True, "b": True, "c": False, "d": False}


def test_tpr_on_grid_is_interp(spark):
    """Ties, vertical steps, one class alone, and the ends of the curve."""
    rng, rows, want = random.Random(5), [], {}
    for key, n, levels in (("ties", 60, 5), ("fine", 400, 10**6), ("two", 2, 1), ("steps", 30, 3)):
        own = [(key, rng.randrange(levels) / levels, rng.randrange(2)) for _ in range(n)] + [(key, 0.5, 0), (key, 0.5, 1)]
        rows += own
        p, q = sum(y for _, _, y in own), sum(1 - y for _, _, y in own)
        points = [(0.0, 0.0)] + [(sum(s >= c and not y for _, s, y in own) / q, sum(s >= c and y for _, s, y in own) / p) for c in sorted({s for _, s, _ in own}, reverse=True)]
        tpr = np.interp(np.linspace(0, 1, 100), [a for a, _ in points], [b for _, b in points])
        tpr[0] = 0.0
        want[key] = tpr
    rows += [("alone", 0.3, 1), ("alone", None, 0)]
    got = metrics.tpr_on_grid(spark.createDataFrame(rows, "k string, score double, label int"), ["k"]).collect()
    assert {r["k"] for r in got} == set(want) and len(got) == 400
    assert all(abs(r["tpr"] - want[r["k"]][r["step"]]) < 1e-9 for r in got)


def test_greedy_cases_by_brute_force(spark):
    """Identities with several rows, ties, nulls, scopes, and classes that take what later ones would have."""
    rng = random.Random(8)
    rows = [(s, v, rng.randrange(12), rng.choice([None, *range(5)]), rng.randrange(2)) for s in ("p", "q") for v in range(60)]
    df = spark.createDataFrame(rows, "scope string, video long, who long, m int, label int").repartition(5)
    classes = [("A", F.col("label") == 0, "m", False), ("B", F.lit(True), "m", False), ("C", F.col("label") == 1, "m", True), ("D", F.lit(True), "m", True)]
    tests = {"A": (lambda r: r[4] == 0, -1), "B": (lambda r: True, -1), "C": (lambda r: r[4] == 1, 1), "D": (lambda r: True, 1)}
    want = []
    for scope in ("p", "q"):
        taken = set()
        for name, (fits, sign) in tests.items():
            own = sorted((r for r in rows if r[0] == scope and fits(r)), key=lambda r: (r[3] is None, sign * (r[3] or 0), sign * r[1]))
            first = {}
            for r in own:
                first.setdefault(r[2], r)
            best = [r for r in first.values() if r[2] not in taken]
            best = sorted(best, key=lambda r: (r[3] is None, sign * (r[3] or 0), sign * r[1]))[:2]
            taken |= {r[2] for r in best}
            want += [(scope, str(r[2]), r[1], name, k + 1) for k, r in enumerate(best)]
    got = selection.greedy_cases(df, classes, "who", 2, ["scope"])
    assert sorted(map(tuple, got.collect())) == sorted(want)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "SinglePartition" not in plan
    assert selection.greedy_cases(df.limit(0), classes, "who", 2).count() == 0


@pytest.fixture
def small_splits(spark):
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield
    spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    spark.conf.unset("spark.sql.files.openCostInBytes")


def test_numbered_lines_over_splits(spark, tmp_path, small_splits):
    texts = {}
    for name, n in (("a", 1), ("b", 400), ("c", 90), ("d", 0)):
        texts[name] = [f"{name} {k} " + "x" * (k % 40) if k % 7 else "" for k in range(n)]
        (tmp_path / f"{name}.txt").write_text("\n".join(texts[name]) + ("\n" if n else ""))
    rows = readers.numbered_lines(spark, str(tmp_path))
    got = {(r["file"].rsplit("/", 1)[1][0], r["line"]): r["value"] for r in rows.collect()}
    assert got == {(name, k + 1): v for name, own in texts.items() for k, v in enumerate(own)}


def test_bad_lines_are_named(spark, tmp_path, small_splits):
    lines = ['{"id": %d}' % k for k in range(200)]
    lines[70], lines[120], lines[121] = '{"id": ', "", '{"id": "x"}'
    (tmp_path / "rows.jsonl").write_text("\n".join(lines) + "\n")
    assert [(r["line"], r["value"]) for r in readers.bad_json_lines(spark, str(tmp_path), "id int").orderBy("line").collect()] == [(71, '{"id": '), (122, '{"id": "x"}')]
    with pytest.raises(ValueError, match=r"rows.jsonl:71: .*rows.jsonl:122"):
        readers.strict_json_lines(spark, str(tmp_path), "id int")
    (tmp_path / "rows.jsonl").write_text('{"id": 4}\n\n')
    assert [r["id"] for r in readers.strict_json_lines(spark, str(tmp_path), "id int").collect() if r["id"] is not None] == [4]


def test_faults_of_a_list(spark, tmp_path):
    (tmp_path / "list.txt").write_text("1  a b.mp4\n\n0 c.mp4\nx d.mp4\n1\n 0   a b.mp4 \n1 c.mp4\n")
    got = readers.label_list_faults(spark, str(tmp_path)).orderBy("line").collect()
    assert [(r["line"], r["fault"]) for r in got] == [(4, "no_label"), (5, "no_path"), (6, "repeated"), (7, "repeated")]


def test_entry_imports_without_a_session():
    import subprocess
    import sys
    from pathlib import Path

    run = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; assert len(e.queries()) > 250"], cwd=Path(__file__).resolve().parent.parent, capture_output=True, text=True, timeout=120)
    assert run.returncode == 0, run.stderr
