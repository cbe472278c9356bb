"""Bootstrap draws against Python's generator, and blocks of replicates against the form with a row a draw and brute force."""

import hashlib
import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from stillwater.operators import replicates, resampling


@pytest.mark.parametrize("number", [0, 1, 1024, 2**32 - 1, 2**32, 2**40 + 7, -5, 2**64 + 3, replicates.stream_number(1024, "x")])
def test_twister_is_pythons_generator(number):
    mine, theirs = replicates.Twister(number), random.Random(number)
    for n in (1, 2, 3, 7, 64, 65, 1000, 4097):
        assert mine.below(n, n).tolist() == [theirs.randrange(n) for _ in range(n)]


def test_2000_replicates_of_the_twister():
    """One sequence a replicate over the strata in sorted order."""
    sizes = [("M1", 7), ("M2", 13), ("real", 20)]
    seed = int.from_bytes(hashlib.sha256(b"1024::absolute").digest()[:8], "big")
    for r in range(2000):
        rng = random.Random(seed + r)
        want = [Counter(rng.randrange(n) for _ in range(n)) for _, n in sizes]
        got = replicates.drawn("twister", 1024, "absolute", r, sizes)
        assert all(w.tolist() == [c[k] for k in range(n)] for w, c, (_, n) in zip(got, want, sizes, strict=True))


def test_portable_draws_are_hashes():
    for n in (5, 9, 3):  # longer and shorter than what is remembered
        got = replicates.drawn("portable", 7, "s", 11, [("real", n)])[0]
        draws = [int(hashlib.md5(f"7::s::11::real::{i}".encode()).hexdigest()[:8], 16) % n for i in range(n)]
        assert got.tolist() == [draws.count(k) for k in range(n)]


@pytest.fixture(scope="module")
def decided(spark):
    """Videos of both datasets, several of one source, with ties, a video without a score and one detector without calibration."""
    rng = random.Random(3)
    out = []
    for d in ("a", "b"):
        for v in range(90):
            dataset, role = ("second", "external") if v % 5 == 4 else ("first", "validation" if v % 5 in (0, 1) else "test")
            label = v // 7 % 2
            method = f"M{v % 4 + 1}" if label and dataset == "first" else ""
            for c in ("CLN", "RSZ", "BLR"):
                score = None if rng.random() < 0.03 else round(rng.random(), 1) + 0.01 * label
                out.append((d, dataset, role, v, label, method, c, score, 0.6, None if score is None else int(score >= 0.6), v // 6))
    schema = "detector string, dataset string, role string, video long, study_label int, manipulation string, condition string, video_score double, threshold_value double, decision int, source long"
    return spark.createDataFrame(out, schema).withColumn("cluster", resampling.cluster()).repartition(3)


def calibration(decided):
    return decided.where("dataset = 'first' and role = 'validation' and condition = 'CLN' and study_label = 0 and video_score is not null and detector = 'a'")


def table(df):
    return sorted(tuple(f"{v:.12g}" if isinstance(v, float) else v for v in r) for r in df.collect())


@pytest.mark.parametrize("unit", ["video", "cluster"])
@pytest.mark.parametrize("form", ["absolute", "paired"])
def test_blocks_are_rows_of_draws(decided, monkeypatch, unit, form):
    run = getattr(resampling, form)
    got = run(decided, calibration(decided), 30, unit=unit)
    monkeypatch.setattr(replicates, "MOST_ROWS", 0)
    want = run(decided, calibration(decided), 30, unit=unit).select(*got.columns)
    assert table(got) == table(want)
    assert {r["replicate"] for r in got.collect()} == set(range(30)) and {r["detector"] for r in got.collect()} == {"a"}


def test_displacement_is_rows_of_draws(decided, monkeypatch):
    clean = calibration(decided).select("detector", "video", F.col("video_score").alias("clean_score"))
    rows = decided.where("role = 'validation' and study_label = 0 and condition <> 'CLN' and video_score is not null").join(clean, ["detector", "video"])
    got = table(resampling.displaced(rows, 40))
    monkeypatch.setattr(replicates, "MOST_ROWS", 0)
    assert got == table(resampling.displaced(rows, 40).select("detector", "condition", "replicate", "displacement"))


def test_metrics_by_brute_force(decided):
    """One replicate by the twister, unit by unit."""
    calib = calibration(decided)
    got = {(r["condition"], r["metric_group"]): r for r in resampling.absolute(decided, calib, 4, unit="cluster", rule="twister").where("replicate = 3 and dataset = 'first'").collect()}

    def bag(rows, stream):
        strata = {}
        for r in rows:
            s = "real" if r["study_label"] == 0 else r["manipulation"] or "manipulated"
            strata.setdefault(s, {}).setdefault(r["cluster"], []).append(r)
        rng, out = random.Random(replicates.stream_number(1024, stream) + 3), []
        for s in sorted(strata):
            units = sorted(strata[s])
            for _ in units:
                out += strata[s][units[rng.randrange(len(units))]]
        return out

    real = sorted(r["video_score"] for r in bag(calib.collect(), "primary_clean_validation"))
    good = [x for x in real if 100 * sum(y >= x for y in real) <= 5 * len(real)]
    cut = min(good) if good else math.nextafter(real[-1], math.inf)
    for c in ("CLN", "RSZ", "BLR"):
        rows = [r for r in decided.collect() if r["detector"] == "a" and r["dataset"] == "first" and r["role"] == "test" and r["condition"] == c and r["video_score"] is not None]
        drawn = bag(rows, "absolute")
        for g in ("M1", "M2", "M3", "M4", "pooled"):
            own = [r for r in drawn if r["study_label"] == 0 or g in (r["manipulation"], "pooled")]
            p = [r["video_score"] for r in own if r["study_label"]]
            q = [r["video_score"] for r in own if not r["study_label"]]
            row = got[c, g]
            if p:
                assert row["auc"] == pytest.approx(sum((x > y) + (x == y) / 2 for x in p for y in q) / len(p) / len(q))
                assert row["fnr"] == pytest.approx(sum(x < cut for x in p) / len(p))
            assert row["fpr"] == pytest.approx(sum(x >= cut for x in q) / len(q))


def test_no_rows_no_replicates(decided):
    assert resampling.absolute(decided.limit(0), calibration(decided), 3).count() == 0
    assert resampling.absolute(decided, calibration(decided).limit(0), 3).count() == 0
    one = replicates.Histogram(np.array([0.5]), np.array([0]))
    assert one.cuts(np.ones((1, 1), np.int64))[0] == math.nextafter(0.5, 1)
