"""Benchmark decontamination with suffix arrays of the training texts.

Each Arrow batch of documents is one shard.  Its words are numbered by the benchmark's vocabulary, and the suffixes
that begin with enough known words (no other can match a window) are sorted into a word-level suffix array.  Every
benchmark suffix is then found in it by binary search; what it finds gives the hit words and the items.  From each hit
place the text is followed through a suffix array of the whole block, one binary search a word, as far as any item goes:
that is the longest verbatim match with its place.  Shards are independent, so nothing is shuffled.

The benchmark goes to the tasks in blocks of at most ``BLOCK_BYTES``: a larger benchmark makes more passes over the
same rows, each adding its hits, and no block grows.

A window is ``WINDOW`` consecutive item words; an item with fewer words, but not none, is one window.  Null or empty
texts have no words, neither in documents nor in items.  Equal items all count; a null item_id is the empty name.  Of
equally long matches the first in the document counts, of the items that have it the smallest name.  Extra columns are
not read.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stillwater.llm import common

WINDOW = 10
BLOCK_BYTES = 8 << 20

_STATE = "ranges array<long>, items array<string>, longest long, longest_start long, longest_item string"


class Block:
    """The benchmark items of one block, as numbers."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int):
        self.window = window
        self.vocab: dict[bytes, int] = {}
        same: dict[tuple[int, ...], list[str]] = defaultdict(list)
        for name, words in items:
            same[tuple(self.vocab.setdefault(w, len(self.vocab) + 1) for w in words)].append(name)
        self.names = list(same.values())
        self.text = np.array([x for item in same for x in (*item, 0)], np.int64)
        found: dict[tuple[int, ...], list[int]] = defaultdict(list)
        for k, item in enumerate(same):
            size = min(window, len(item))
            for i in range(len(item) - size + 1):
                w = item[i : i + size]
                if k not in found[w][-1:]:
                    found[w].append(k)
        self.starts = np.cumsum([0, *(len(item) + 1 for item in same)])
        self.order = self.suffixes(max(map(len, same), default=0))
        self.items = list(found.values())
        self.sizes = np.array([len(w) for w in found], np.int64)
        self.kind = ">u2" if len(self.vocab) < 65535 else ">u4"
        low, high = np.zeros((len(found), window), self.kind), np.full((len(found), window), np.iinfo(self.kind[1:]).max, self.kind)
        for k, w in enumerate(found):
            low[k, : len(w)] = w
            high[k, : len(w)] = w
        self.low, self.high = self.keys(low), self.keys(high)
        self.least = int(self.sizes.min()) if len(found) else 0

    def suffixes(self, longest: int) -> np.ndarray:
        """Places of the text in the order of what follows them, by doubling."""
        n = len(self.text)
        rank, size = self.text, 1
        while True:
            ahead = np.zeros(n, np.int64)
            if size < n:
                ahead[:-size] = rank[size:] + 1
            both = rank * (n + len(self.vocab) + 2) + ahead
            order = np.argsort(both, kind="stable")
            size *= 2
            if size > longest:
                return order
            rank = np.zeros(n, np.int64)
            rank[order] = np.cumsum(np.diff(both[order], prepend=both[order[:1]]) > 0)

    def follow(self, ids: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """How many words from each place on any item has in a row, and the range of ``order`` that has them."""
        length, low, high = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64), np.full(len(at), len(self.order), np.int64)
        live = np.arange(len(at))
        text = np.concatenate([self.text, np.zeros(1, np.int64)])
        while len(live):
            word = ids[at[live] + length[live]]
            live, word = live[word > 0], word[word > 0]
            edges = []
            for least in (word, word + 1):  # the first suffix whose next word is no smaller
                a, b = low[live], high[live]
                while (a < b).any():
                    mid = (a + b) // 2
                    inside = np.minimum(mid, len(self.order) - 1)
                    less = (text[np.minimum(self.order[inside] + length[live], len(text) - 1)] < least) & (a < b)  # places that are done aren't looked at
                    a, b = np.where(less, mid + 1, a), np.where(less | (a >= b), b, mid)
                edges.append(a)
            some = edges[0] < edges[1]
            live = live[some]
            low[live], high[live] = edges[0][some], edges[1][some]
            length[live] += 1
        return length, low, high

    def first_name(self, low: int, high: int) -> str:
        items = np.unique(np.searchsorted(self.starts, self.order[low:high], "right") - 1)
        return min(name for k in items.tolist() for name in self.names[k])

    def keys(self, rows: np.ndarray) -> np.ndarray:
        return np.ascontiguousarray(rows).view(f"S{rows.shape[1] * rows.dtype.itemsize}").ravel()


def search(block: Block, docs: list[list[bytes]]) -> Iterator[tuple[int, list[int], list[str], int, int, str | None]]:
    """For each document with a hit: its index, hit ranges as flat pairs, items, longest match, its start and item."""
    starts = np.cumsum([0] + [len(d) + 1 for d in docs])
    ids = np.zeros(int(starts[-1]) + block.window + 1, np.int64)
    get = block.vocab.get
    for at, words in zip(starts.tolist(), docs, strict=False):
        ids[at : at + len(words)] = list(map(get, words, repeat(0)))
    n = len(ids)
    zero = np.flatnonzero(ids == 0)
    ahead = np.zeros(n, np.int64)  # known words from here on
    nxt = zero[np.searchsorted(zero, np.arange(n))]
    ahead = nxt - np.arange(n)
    places = np.flatnonzero(ahead >= block.least)
    if not len(places) or not block.least:
        return
    heads = ids[places[:, None] + np.arange(block.window)[None, :]]
    heads[np.arange(block.window)[None, :] >= ahead[places][:, None]] = 0
    keys = block.keys(heads.astype(block.kind))
    order = np.argsort(keys, kind="stable")
    suffixes, keys = places[order], keys[order]
    lo, hi = np.searchsorted(keys, block.low, "left"), np.searchsorted(keys, block.high, "right")
    some = np.flatnonzero(hi > lo)
    if not len(some):
        return
    count = (hi - lo)[some]
    window_of = np.repeat(some, count)
    offset = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    at = suffixes[np.repeat(lo[some], count) + offset]
    doc_of = np.searchsorted(starts, at, "right") - 1
    edges = np.zeros(n + 1, np.int64)
    np.add.at(edges, at, 1)
    np.add.at(edges, at + block.sizes[window_of], -1)
    hit = np.cumsum(edges[:-1]) > 0
    places = np.unique(at)
    length, low, high = block.follow(ids, places)
    owner = np.searchsorted(starts, places, "right") - 1
    by_doc = np.lexsort((places, -length, owner))
    best = {int(owner[k]): k for k in by_doc[np.flatnonzero(np.diff(owner[by_doc], prepend=-1))].tolist()}
    pairs = np.unique(doc_of * len(block.sizes) + window_of)
    items: dict[int, set[int]] = defaultdict(set)
    for p in pairs.tolist():
        items[p // len(block.sizes)].update(block.items[p % len(block.sizes)])
    for d, found in sorted(items.items()):
        own = hit[starts[d] : starts[d] + len(docs[d])].astype(np.int8)
        turn = np.flatnonzero(np.diff(own, prepend=0, append=0)).tolist()
        k = best[d]
        yield d, turn, [x for i in sorted(found) for x in block.names[i]], int(length[k]), int(places[k] - starts[d]), block.first_name(low[k], high[k])


def _pass(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    block = shared.value
    for batch in batches:
        state = [batch.column(name).to_pylist() for name in ("ranges", "items", "longest", "longest_start", "longest_item")]
        for d, ranges, items, longest, start, item in search(block, [common.letter_words(t) for t in batch.column("text").to_pylist()]):
            state[0][d] = state[0][d] + ranges
            state[1][d] = state[1][d] + items
            if (-longest, start, item) < (-state[2][d], state[3][d] or 0, state[4][d] or ""):
                state[2][d], state[3][d], state[4][d] = longest, start, item
        kinds = [pa.list_(pa.int64()), pa.list_(pa.string()), pa.int64(), pa.int64(), pa.string()]
        yield pa.RecordBatch.from_arrays([*batch.columns[:-5], *(pa.array(s, k) for s, k in zip(state, kinds, strict=True))], names=batch.schema.names)


def _sum_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        words, hits, n_items, digests = [], [], [], []
        for text, ranges, items in zip(*(batch.column(c).to_pylist() for c in ("text", "ranges", "items")), strict=True):
            n = len(common.letter_words(text))
            edges = np.zeros(n + 1, np.int64)
            pairs = np.array(ranges, np.int64).reshape(-1, 2)
            np.add.at(edges, pairs[:, 0], 1)
            np.add.at(edges, pairs[:, 1], -1)
            words.append(n)
            hits.append(int((np.cumsum(edges[:n]) > 0).sum()))
            n_items.append(len(items))
            digests.append(hashlib.sha256(",".join(sorted(items)).encode()).hexdigest())
        kept = [c for c in batch.schema.names if c not in ("text", "ranges", "items")]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(words, pa.int64()), pa.array(hits, pa.int64()), pa.array(n_items, pa.int64()), pa.array(digests)], names=[*kept, "n_words", "n_hit", "n_items", "items_sha256"])


def _blocks(spark, benchmark: DataFrame, window: int, block_bytes: int) -> Iterator[Block]:
    """Items in blocks of bounded size; only one is in the driver's memory at a time."""
    items, size = [], 0
    for row in benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text").where("text is not null").toLocalIterator():
        words = common.letter_words(row["text"])
        if words:
            items.append((row["item_id"] or "", words))
            size += len(row["text"])
            if size >= block_bytes:
                yield Block(items, window)
                items, size = [], 0
    if items:
        yield Block(items, window)


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row a document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, and the longest verbatim
    match (longest words, from word longest_start, of longest_item; 0 and null without one).
    """
    spark = common.prepare(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), common.text_of().alias("text"), F.expr("cast(array() as array<long>)").alias("ranges"), F.expr("cast(array() as array<string>)").alias("items"), F.lit(0).cast("long").alias("longest"), F.lit(None).cast("long").alias("longest_start"), F.lit(None).cast("string").alias("longest_item"))
    for block in _blocks(spark, benchmark, window, block_bytes):
        shared = spark.sparkContext.broadcast(block)
        rows = rows.mapInArrow(lambda it, shared=shared: _pass(it, shared), rows.schema)
    out = rows.mapInArrow(_sum_up, "doc_id long, longest long, longest_start long, longest_item string, n_words long, n_hit long, n_items long, items_sha256 string")
    return out.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", (F.col("n_hit") > 0).alias("contaminated"), "longest", "longest_start", "longest_item")


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The documents without any hit word, with all their columns.  No row is shuffled."""
    spark = common.prepare(docs.sparkSession)
    kept = docs
    for block in _blocks(spark, benchmark, window, block_bytes):
        shared = spark.sparkContext.broadcast(block)

        def clean(batches, shared=shared):
            for batch in batches:
                hit = {d for d, *_ in search(shared.value, [common.letter_words(t) for t in batch.column("text").to_pylist()])}
                yield batch.filter(pa.array([i not in hit for i in range(batch.num_rows)], pa.bool_()))

        kept = kept.mapInArrow(clean, kept.schema)
    return kept
