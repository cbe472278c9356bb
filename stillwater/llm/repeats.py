"""Substring dedup by recompression.

The words of a document are symbols.  A round renames them: runs of one symbol become one name in the rounds of
``RUN_ROUNDS``, then each pair of a left and a right symbol becomes one name.  Names are hashes of what they stand for
and the sides are a bit of the name, so all tasks of a job give equal pairs equal names without asking each other, and
equal substrings get equal names but for their ends.  Each symbol carries its context, the words that decided about it:
wherever those words stand, the symbol stands.

A window (``WINDOW`` words) is filed under the highest symbol whose context lies inside it, so equal windows are filed
alike.  Symbols that only one text has are dropped; windows filed under shared ones are the candidates, and a candidate
is verified by a 128-bit BLAKE2 digest of its words themselves: it goes if a document with a smaller doc_id has it too.

A text's whole sequence of words is its topmost name, which is checked against its SHA-256 (another seed should two
sequences ever share a name).  Copies of a text are one text: all but the first lose every word that a window covers, and
only the first takes part further on.

Null texts have no words.  Rows without doc_id come after all others and never take words from them.  Rows that repeat
a doc_id are separate texts of equal rank: neither takes from the other.  Extra columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stillwater.llm import common

WINDOW = 50
ROUNDS, RUN_ROUNDS = 8, (0,)
LAST = (1 << 63) - 1
#: A worker takes texts by so many characters and candidate windows by so many at a time, however much a batch holds.
PIECE, MANY = 1 << 19, 1 << 17

_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def _inverse(base: np.uint64) -> np.uint64:
    return np.uint64(pow(int(base), -1, 1 << 64))


class Texts:
    """Some documents' words as hashes in one array, a place without word after each document."""

    def __init__(self, flat: np.ndarray, sizes: np.ndarray):
        self.sizes = sizes
        self.starts = np.cumsum(self.sizes + 1) - self.sizes  # one empty place comes first
        self.n = int(self.starts[-1] + self.sizes[-1] + 1) if len(sizes) else 1
        self.words = np.zeros(self.n, np.uint64)
        self.real = np.zeros(self.n, bool)
        self.real[np.repeat(self.starts - np.cumsum(self.sizes) + self.sizes, self.sizes) + np.arange(len(flat))] = True
        self.words[self.real] = flat
        self._sums = {}

    def spans(self, a: np.ndarray, b: np.ndarray, base: np.uint64) -> np.ndarray:
        """A hash of the words from a to b (exclusive), wherever they stand."""
        if base not in self._sums:
            sums = np.zeros(self.n + 1, np.uint64)
            sums[1:] = np.cumsum(common.mix64(self.words ^ base) * _powers(base, self.n))
            self._sums[base] = sums, _powers(_inverse(base), self.n + 1)
        sums, back = self._sums[base]
        return common.mix64((sums[b] - sums[a]) * back[a] + (b - a).astype(np.uint64))

    def windows(self) -> np.ndarray:
        """Starts of all windows."""
        count = np.maximum(self.sizes - WINDOW + 1, 0)
        return np.repeat(self.starts - np.cumsum(count) + count, count) + np.arange(count.sum())

    def doc_of(self, places: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.starts, places, "right") - 1


def _rounds(t: Texts) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Names, context starts and context ends (exclusive) of the symbols after each round, from the words on."""
    place = np.arange(t.n)
    # places without word are symbols of their own that never merge and whose neighbours see past them
    name, low, high, real = common.mix64(t.words + np.uint64(1)), place, place + 1, t.real
    yield name[real], low[real], high[real]
    for k in range(ROUNDS):
        if k in RUN_ROUNDS:
            head = np.ones(len(name), bool)
            head[1:] = (name[1:] != name[:-1]) | ~real[1:] | ~real[:-1]
            at = np.flatnonzero(head)
            size = np.diff(np.append(at, len(name)))
            last = at + size - 1
            run = common.mix64(name[at] ^ common.mix64(size.astype(np.uint64) * _A))
            # that a run ends is decided by the symbols beside it
            low, high = low[np.maximum(at - 1, 0)], high[np.minimum(last + 1, len(name) - 1)]
            name, real = np.where(size > 1, run, name[at]), real[at]
        left = (common.mix64(name + np.uint64(k * int(_B) & 0xFFFFFFFFFFFFFFFF)) & np.uint64(1)).astype(bool)
        first = np.zeros(len(name), bool)
        first[:-1] = left[:-1] & ~left[1:] & real[:-1] & real[1:]
        second = np.zeros(len(name), bool)
        second[1:] = first[:-1]
        single = ~first & ~second
        before, after = low[np.maximum(np.arange(len(name)) - 1, 0)], high[np.minimum(np.arange(len(name)) + 1, len(name) - 1)]
        new_low = np.where(single & ~left & real, before, low)
        new_high = np.where(first, after, np.where(single & left & real, after, high))
        merged = name.copy()
        at = np.flatnonzero(first)
        merged[at] = common.mix64(common.mix64(name[at] * _A + np.uint64(k)) + name[at + 1] * _B)
        keep = ~second
        name, low, high, real = merged[keep], new_low[keep], new_high[keep], real[keep]
        yield name[real], low[real], high[real]


def anchors(t: Texts) -> tuple[np.ndarray, np.ndarray]:
    """All windows' starts, and what each is filed under."""
    starts = t.windows()
    keys = np.zeros(len(starts), np.uint64)
    open_ = np.ones(len(starts), bool)
    for k, (name, low, high) in reversed(list(enumerate(_rounds(t)))):
        if not len(name):
            continue
        some = np.flatnonzero(open_)
        if not len(some):
            break
        at = np.searchsorted(low, starts[some])
        fits = at < len(low)
        at = np.minimum(at, len(low) - 1)
        fits &= high[at] <= starts[some] + WINDOW
        own, at = some[fits], at[fits]
        keys[own] = common.mix64(name[at] + t.spans(low[at], high[at], _A) + np.uint64(k))
        open_[own] = False
    return starts, keys


def _root(words: bytes, seed: int) -> int:
    """The topmost name of a sequence of words, joined by spaces."""
    return int.from_bytes(hashlib.blake2b(words, digest_size=8, salt=seed.to_bytes(8, "little")).digest(), "little", signed=True)


def _documents(docs: DataFrame, seed: int) -> DataFrame:
    """doc_id, rank (doc_id, LAST for null), row, root, n_words, all_sha256."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.released(batches):
            roots, counts, digests = [], [], []
            for text in batch.column("text").to_pylist():
                words = common.space_words(text)
                joined = b" ".join(words)
                roots.append(_root(joined, seed))
                counts.append(len(words))
                digests.append(hashlib.sha256(joined).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("row"), pa.array(roots, pa.int64()), pa.array(counts, pa.int64()), pa.array(digests, pa.string())], names=["doc_id", "row", "root", "n_words", "all_sha256"])

    found = _rows(docs, seed).mapInArrow(run, "doc_id long, row long, root long, n_words long, all_sha256 string")
    return found.withColumn("rank", F.coalesce("doc_id", F.lit(LAST)))


def _rows(docs: DataFrame, seed: int) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), common.text_of().alias("text")).withColumn("row", F.xxhash64("doc_id", "text", F.lit(seed)))


def _pieces(texts: Iterable[str]) -> Iterator[tuple[int, list[str]]]:
    """The texts in lists that end with the text that fills ``PIECE``, each with the place of its first."""
    own, size, first = [], 0, 0
    for k, text in enumerate(texts):
        own.append(text)
        size += len(text)
        if size >= PIECE:
            yield first, own
            own, size, first = [], 0, k + 1
    if own:
        yield first, own


def _lists(column: pa.ListArray) -> Iterator[np.ndarray]:
    """Each row's numbers."""
    values, cut = column.values.to_numpy(), column.offsets.to_pylist()
    return (values[a:b] for a, b in zip(cut, cut[1:], strict=False))


def _filed(docs: DataFrame, seed: int) -> DataFrame:
    """key, root: what the windows of each text are filed under."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for _, texts in (x for batch in common.released(batches) for x in _pieces(batch.column(0).to_pylist())):
            flat, sizes = common.word_hashes(texts)
            roots, new = [_root(b" ".join(common.space_words(x)), seed) for x in texts], np.zeros(len(sizes), bool)
            for k, (root, size) in enumerate(zip(roots, sizes.tolist(), strict=True)):
                if size >= WINDOW and root not in seen:
                    new[k] = True
                    if len(seen) < 1_000_000:
                        seen.add(root)
            if new.any():
                t = Texts(flat[np.repeat(new, sizes)], sizes[new])
                roots = [r for r, yes in zip(roots, new.tolist(), strict=True) if yes]
                starts, keys = anchors(t)
                owner = t.doc_of(starts)
                new = np.ones(len(keys), bool)  # neighbours are mostly filed alike
                new[1:] = (keys[1:] != keys[:-1]) | (owner[1:] != owner[:-1])
                yield pa.RecordBatch.from_arrays([pa.array(common.int64(keys[new])), pa.array(np.array(roots, np.int64)[owner[new]])], names=["key", "root"])

    return docs.select(common.text_of().alias("text")).mapInArrow(run, "key long, root long")


def _digests(texts: list[str], owner: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of the words of each window, as two numbers; owners stand in order."""
    out, cut = [], np.searchsorted(owner, np.arange(len(texts) + 1)).tolist()
    for k, text in enumerate(texts):
        own = places[cut[k] : cut[k + 1]].tolist()
        if own:
            words = common.space_words(text)
            joined = b" ".join(words)
            begin = np.cumsum([0] + [len(w) + 1 for w in words]).tolist()
            out += [hashlib.blake2b(joined[begin[i] : begin[i + WINDOW] - 1], digest_size=16).digest() for i in own]
    both = np.frombuffer(b"".join(out), np.int64).reshape(-1, 2)
    return both[:, 0].copy(), both[:, 1].copy()


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """hash_a, hash_b, rank, row, place, found: candidate windows; found: a smaller rank among those judged together has
    it, so its digest, which nobody needs any more, is 0."""
    some, n = [], 0
    for batch in common.released(batches):
        ranks, rows = (batch.column(c).to_numpy() for c in ("rank", "row"))
        shared = _lists(batch.column("keys"))
        for first, texts in _pieces(common.unpack(batch.column("text").to_pylist())):
            t = Texts(*common.word_hashes(texts))
            starts, keys = anchors(t)
            owner = t.doc_of(starts)
            keys = common.int64(keys)
            cut = np.searchsorted(owner, np.arange(len(texts) + 1)).tolist()
            chosen = np.concatenate([np.zeros(0, np.int64), *(a + np.flatnonzero(np.isin(keys[a:b], next(shared))) for a, b in zip(cut, cut[1:], strict=False))]).astype(np.int64)
            starts, owner = starts[chosen], owner[chosen]
            places = starts - t.starts[owner]
            some.append((*_digests(texts, owner, places), ranks[first + owner], rows[first + owner], places.astype(np.int32)))
            n += len(places)
            if n >= MANY:
                yield from _judged(some)
                some, n = [], 0
    if n:
        yield from _judged(some)


def _judged(some: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
    a, b, ranks, rows, places = map(np.concatenate, zip(*some, strict=True))
    by = np.lexsort((ranks, b, a))
    a, b, ranks, rows, places = a[by], b[by], ranks[by], rows[by], places[by]
    head = np.ones(len(a), bool)
    head[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    found = ranks > ranks[np.flatnonzero(head)][np.cumsum(head) - 1]
    a, b = np.where(found, 0, a), np.where(found, 0, b)
    for k in range(0, len(a), 25_000):
        s = slice(k, k + 25_000)
        yield pa.RecordBatch.from_arrays([pa.array(x[s]) for x in (a, b, ranks, rows, places, found)], names=["hash_a", "hash_b", "rank", "row", "place", "found"])


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in common.released(batches):
        gone, digests = [], []
        for text, places in zip(common.unpack(batch.column("text").to_pylist()), _lists(batch.column("places")), strict=True):
            words = common.space_words(text)
            edges = np.zeros(len(words) + 1, np.int64)
            np.add.at(edges, places, 1)
            np.add.at(edges, places + WINDOW, -1)
            covered = np.cumsum(edges[:-1]) > 0
            gone.append(int(covered.sum()))
            digests.append(hashlib.sha256(b" ".join(w for w, c in zip(words, covered.tolist(), strict=True) if not c)).hexdigest())
        yield pa.RecordBatch.from_arrays([batch.column("root"), pa.array(gone, pa.int64()), pa.array(digests, pa.string())], names=["root", "gone", "cut_sha256"])


def cut_repeats(docs: DataFrame) -> DataFrame:
    """One row a document: doc_id, n_words, n_removed, kept_sha256."""
    spark = common.prepare(docs.sparkSession, 1 << 20)
    scratch = common.Scratch(spark, "repeats")
    for seed in range(16):
        documents = scratch.table(_documents(docs, seed), f"documents-{seed}")
        # neither topmost names nor the hashes that tell rows apart may stand for different words
        same = [documents.groupBy(key).agg(F.min("all_sha256").alias("a"), F.max("all_sha256").alias("b")).where("a != b").isEmpty() for key in ("root", "row")]
        if all(same):
            break
    # the first of equal texts; of equal ranks any row, as their words are the same
    best = documents.groupBy("root").agg(F.min(F.struct("rank", "row")).alias("m"), F.count("*").alias("n"))
    texts = scratch.table(best.select("root", F.col("m.rank").alias("rank"), F.col("m.row").alias("row"), "n"), "texts")
    filed = scratch.table(_filed(docs, seed), "filed")
    held_by = filed.groupBy("key").agg(F.min("root").alias("a"), F.max("root").alias("b"), F.count("*").alias("n"))
    several = scratch.table(held_by.where("a != b").select("key", "n"), "several")
    found = common.heavy_light_join(filed, several, ["key"], "n", filed.count())
    shared = scratch.table(found.groupBy("root").agg(F.collect_set("key").alias("keys")), "shared")
    scratch.drop("filed")
    common.release(spark)
    wanted = shared.join(texts, "root").select("root", "rank", "row", "keys")
    held = scratch.table(wanted.join(common.packed(_rows(docs, seed).select("row", "text")), "row").dropDuplicates(["root"]), "held")
    common.release(spark)
    windows = held.select("rank", "root", "text", "keys").withColumnRenamed("root", "row").mapInArrow(_candidates, "hash_a long, hash_b long, rank long, row long, place int, found boolean")
    windows = scratch.table(windows, "windows")
    open_ = windows.where("not found").drop("found")
    first = open_.groupBy("hash_a", "hash_b").agg(F.min("rank").alias("least"), F.max("rank").alias("most"), F.count("*").alias("n"))
    first = scratch.table(first.where("least < most").drop("most"), "first")
    later = common.heavy_light_join(open_, first, ["hash_a", "hash_b"], "n", open_.count()).where("rank > least")
    seen = windows.where("found").select("row", "place").unionByName(later.select("row", "place"))
    places = scratch.table(seen.groupBy(F.col("row").alias("root")).agg(F.collect_list("place").alias("places")), "places")
    scratch.drop("windows")
    common.release(spark)
    cut = scratch.table(held.select("root", "text").join(places, "root").mapInArrow(_cut, "root long, gone long, cut_sha256 string"), "cut")
    common.release(spark)
    total = documents.count()
    known = texts.join(cut, "root", "left").where("n > 1 or gone is not null").select(F.col("root").cast("string").alias("root"), F.col("rank").alias("first"), "gone", "cut_sha256", "n")
    joined = common.attach(documents.withColumn("root", F.col("root").cast("string")), known, "root", "n", total, ["first", "gone", "cut_sha256"], ["row"])
    copy = (F.col("rank") > F.col("first")) & (F.col("n_words") >= WINDOW)
    empty = hashlib.sha256(b"").hexdigest()
    return joined.select("doc_id", "n_words", F.when(copy, F.col("n_words")).otherwise(F.coalesce("gone", F.lit(0).cast("long"))).alias("n_removed"), F.when(copy, F.lit(empty)).otherwise(F.coalesce("cut_sha256", "all_sha256")).alias("kept_sha256"))
