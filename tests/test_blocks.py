"""Draws in blocks: their digests, what a task holds of them, and what detectors share."""

import hashlib
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from stillwater.operators import replicates, resampling


@pytest.mark.parametrize("length", [0, 1, 55, 56, 63, 64, 119, 120, 200])
def test_md5_heads(length):
    texts = np.random.default_rng(length).integers(0, 256, (5, length), np.uint8)
    assert replicates.md5_heads(texts).tolist() == [int(hashlib.md5(t.tobytes()).hexdigest()[:8], 16) for t in texts]


def test_numbers_of_all_widths(monkeypatch):
    monkeypatch.setattr(replicates, "AT_ONCE", 7)
    got = replicates.portable_numbers(1024, "é" * 30, range(8, 103), "real", 12)
    assert got.shape == (95, 12)
    assert got.tolist() == [[int(hashlib.md5(f"1024::{'é' * 30}::{r}::real::{i}".encode()).hexdigest()[:8], 16) for i in range(12)] for r in range(8, 103)]
    assert replicates.portable_numbers(1, "s", range(3), "real", 0).shape == (3, 0)


@pytest.fixture(scope="module")
def numbered(spark):
    rows = spark.range(50).select(F.concat(F.lit("d"), F.col("id") % 1).alias("detector"), F.when(F.col("id") < 13, "real").otherwise("M1").alias("stratum"), F.col("id").alias("video"))
    return resampling.units(rows, ["detector"])


def test_replicates_of_a_stratum_are_many_tasks(numbered, monkeypatch):
    """One task counted the draws of all replicates of a stratum."""
    monkeypatch.setattr(replicates, "HELD", 100)
    want = {(s, r, k): w for s, n in (("real", 13), ("M1", 37)) for r in range(20) for k, w in enumerate(replicates.drawn("portable", 5, "x", r, [(s, n)])[0].tolist()) if w}
    for most in (1 << 20, 0):
        monkeypatch.setattr(replicates, "MOST_ROWS", most)
        drawn = resampling.draws(numbered, ["detector"], 20, 5, "x")
        assert {(r["stratum"], r["replicate"], r["k"]): r["w"] for r in drawn.collect()} == want
        assert drawn.where("stratum = 'M1'").select(F.spark_partition_id()).distinct().count() > 1


def test_a_block_holds_few_entries():
    """A task's arrays don't grow with the product of replicates and rows."""
    n = 20_000
    import pyarrow as pa

    table = pa.table({"stratum": ["real"] * n, "unit": [str(k) for k in range(n)]})
    scores = np.random.default_rng(0).random(n)
    strata = replicates.Strata(table)
    cells = replicates.Cells(strata, np.arange(n) % 2, {"pooled": np.arange(n)}, scores)
    draws = replicates.Draws("portable", 1, "x", [strata])
    tracemalloc.start()
    for block in list(replicates._blocks(range(250), n))[:2]:
        draws.start(block)
        assert [g for g, _ in cells.metrics(draws.counts(strata), np.full(len(block), 0.5))] == ["pooled"]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 50e6


def test_detectors_share_numbers(monkeypatch):
    """Each number was hashed once a detector."""
    import pyarrow as pa

    calls, own = [], replicates.portable_numbers
    monkeypatch.setattr(replicates, "portable_numbers", lambda *a: calls.append(a[3:]) or own(*a))
    short, long = (replicates.Strata(pa.table({"stratum": ["M1", "real"] * n, "unit": [f"u{k}" for k in range(2 * n)]})) for n in (3, 8))
    draws = replicates.Draws("portable", 1, "x", [short, long])
    draws.start(range(2, 6))
    for strata, n in ((short, 3), (long, 8)):
        counts = draws.counts(strata)
        for k, r in enumerate(range(2, 6)):
            assert [counts[s][k].tolist() for s in ("M1", "real")] == [w.tolist() for w in replicates.drawn("portable", 1, "x", r, [("M1", n), ("real", n)])]
    assert sorted(calls[:2]) == [("M1", 8), ("real", 8)]


@pytest.mark.parametrize("stream", ["absolute", "é" * 40])
def test_only_words_with_digits_of_places_are_arrays(monkeypatch, stream):
    """All 16 words of each text were built and went through all 64 rounds, also where a replicate's texts agree."""
    seen, own = [], replicates._md5_of_words
    monkeypatch.setattr(replicates, "_md5_of_words", lambda words, n: seen.append(sum(isinstance(x, np.ndarray) for x in words)) or own(words, n))
    monkeypatch.setattr(replicates, "AT_ONCE", 1 << 10)
    got = replicates.portable_numbers(1024, stream, range(999, 1001), "real", 3000)
    assert max(seen) <= 3
    assert got[:, [0, 9, 10, 999, 1000, 2999]].tolist() == [[int(hashlib.md5(f"1024::{stream}::{r}::real::{i}".encode()).hexdigest()[:8], 16) for i in (0, 9, 10, 999, 1000, 2999)] for r in (999, 1000)]
