"""What a worker of op9_repeats holds doesn't follow the batch, nor does its result."""

import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
import zstandard

from stillwater.llm import common, repeats


class Captured:
    """Stands for the documents and keeps the function that runs on them."""

    def select(self, *columns):
        return self

    def mapInArrow(self, run, schema):
        self.run = run
        return self


def texts_of(n, size, seed=1):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(5000)]
    passage = rng.choices(words, k=90)
    return [" ".join(rng.choices(words, k=size // 2) + passage + rng.choices(words, k=size // 2)) for _ in range(n)]


def filed(texts):
    docs = Captured()
    repeats._filed(docs, 0)
    return docs.run(iter([pa.RecordBatch.from_arrays([pa.array(texts)], names=["text"])]))


def candidates(texts, shared):
    small = zstandard.ZstdCompressor(level=1)
    ids = pa.array(range(len(texts)), pa.int64())
    batch = pa.RecordBatch.from_arrays([ids, ids, pa.array([small.compress(x.encode()) for x in texts], pa.binary()), pa.array([shared] * len(texts), pa.list_(pa.int64()))], names=["rank", "row", "text", "keys"])
    return repeats._candidates(iter([batch.slice(0, 1), batch.slice(1)]))


def shared_keys(texts):
    """What all texts have windows filed under."""
    own = []
    for text in texts:
        own.append(set(common.int64(repeats.anchors(repeats.Texts(*common.word_hashes([text])))[1]).tolist()))
    return sorted(set.intersection(*own))


@pytest.mark.parametrize("step", ["filed", "candidates"])
def test_memory_does_not_follow_the_batch(spark, step):
    texts = texts_of(300, 4000)  # 7 MB
    batches = filed(texts) if step == "filed" else candidates(texts, shared_keys(texts[:3]))
    tracemalloc.start()
    try:
        rows = sum(x.num_rows for x in batches)
        most = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert rows >= 300
    assert most < 60e6


def test_same_windows_in_any_pieces(monkeypatch):
    texts = ["", *texts_of(30, 400), "short text", *texts_of(2, 3000)[:1], "", *texts_of(30, 400)[:3]]
    long = [x for x in texts if len(x) > 50]
    shared = shared_keys(long[:4])
    assert shared
    told = []
    for piece, many in ((1 << 40, 1 << 40), (1, 1), (3000, 200)):
        monkeypatch.setattr(repeats, "PIECE", piece, raising=False)
        monkeypatch.setattr(repeats, "MANY", many, raising=False)
        rows = [r for x in candidates(texts, shared) for r in x.to_pylist()]
        assert len({(r["row"], r["place"]) for r in rows}) == len(rows)
        least = {}
        for r in rows:
            if not r["found"]:
                key = r["hash_a"], r["hash_b"]
                least[key] = min(least.get(key, r["rank"]), r["rank"])
        told.append(({(r["row"], r["place"]) for r in rows}, {(r["row"], r["place"]) for r in rows if r["found"] or r["rank"] > least[r["hash_a"], r["hash_b"]]}))
    # every text after the first loses the passage, and all ways of taking the texts agree
    assert told[0] == told[1] == told[2]
    assert told[0][1]
    words = [common.space_words(x) for x in texts]
    seen, lost = {}, set()
    for k, w in enumerate(words):
        for i in range(len(w) - repeats.WINDOW + 1):
            key = tuple(w[i : i + repeats.WINDOW])
            if seen.setdefault(key, k) < k:
                lost.add((k, i))
    assert told[0][1] == {x for x in lost if x in told[0][0]}


def test_lists_of_a_slice():
    column = pa.array([[1, 2], [], [3], [4, 5, 6]], pa.list_(pa.int32())).slice(1)
    assert [x.tolist() for x in repeats._lists(column)] == [[], [3], [4, 5, 6]]
    assert np.concatenate(list(repeats._lists(column))).dtype == np.int32
