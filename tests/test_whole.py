"""Queries of the whole job, which have no SQL, against brute force."""

from collections import defaultdict

import pyarrow.parquet as pq
import pytest

from stillwater.plans import registry

SF, WIDE = "/root/testdata/sf0.001", "/root/testdata/sf0.01"  # the smallest has no video from 20 on
CONDITIONS = {"view": 0, "click": 1, "error": 2, "purchase": 3}
NAMES = ("CLN", "RSZ", "BLR", "H40", "PLT")


def rows(name, *columns, sf=SF):
    return pq.read_table(f"{sf}/{name}.parquet", columns=list(columns)).to_pylist()


def test_src_07_whole(spark):
    lists = defaultdict(list)
    for r in rows("conversations", "conv_id", "role", "turn", "text"):
        lists[r["conv_id"], r["role"]].append((r["turn"], r["text"]))
    want = [("d", role, "train", str(c), k, text) for (c, role), own in lists.items() for k, (_, text) in enumerate(sorted(own))]
    got = registry.QUERIES["src_07_whole"](spark, SF).select("dataset", "label", "split", "video", "position", "frame").collect()
    assert sorted(map(tuple, got)) == sorted(want)
    assert sorted(map(tuple, got)) == sorted(map(tuple, registry.QUERIES["src_07"](spark, SF).select(*got[0].asDict()).collect()))


@pytest.mark.parametrize("name", ["srt_01_whole", "srt_02_whole"])
def test_srt_01_whole(spark, name):
    pairs = sorted({(r["user_id"], CONDITIONS.get(r["event_type"], 4)) for r in rows("events", "user_id", "event_type", sf=WIDE)})
    want = [(v, NAMES[c], k + 1) for k, (v, c) in enumerate(pairs)]
    got = registry.QUERIES[name](spark, WIDE).select("video", "condition", "place").collect()
    assert sorted(map(tuple, got), key=lambda r: r[2]) == want
    assert max(r["video"] for r in got) >= 20


def test_agg_36_whole(spark):
    groups, brands = defaultdict(list), defaultdict(list)
    for r in rows("part", "p_brand", "p_size", "p_retailprice", "p_partkey"):
        groups[r["p_brand"], r["p_size"]].append((-float(r["p_retailprice"]), r["p_partkey"]))
    means = {}
    for key, own in groups.items():
        best = sorted(own)[:3]
        means[key] = -sum(x for x, _ in best) / len(best)
        brands[key[0]].append(means[key])
    got = {(r["p_brand"], r["p_size"]): (float(r["m"]), float(r["mean"])) for r in registry.QUERIES["agg_36_whole"](spark, SF).collect()}
    assert set(got) == set(means)
    for key, (m, mean) in got.items():
        assert m == pytest.approx(means[key], abs=2e-6) and mean == pytest.approx(sum(brands[key[0]]) / len(brands[key[0]]), abs=2e-6)


@pytest.mark.parametrize("name", ["f5_bootstrap", "bst_08", "bst_14"])
def test_intervals_of_2000_replicates(name):
    """No query or SQL draws fewer than the study does."""
    assert "range(0, 2000)" in registry.ORACLE[name] and "range(0, 20)" not in registry.ORACLE[name]


def test_bst_09_has_2000_replicates(spark):
    assert {r["n_replicates"] for r in registry.QUERIES["bst_09"](spark, SF).collect()} == {2000}
