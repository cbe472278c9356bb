"""Bootstrap replicates as blocks of a weight matrix.

A task holds the rows of one context (a dataset's videos of one role and condition, of all detectors) and a range of
replicates, of which it takes a few at a time.  How often each unit was drawn is a matrix of replicates by units, and the
metrics come from its sums in the order of scores, so no row stands for a draw.  The detectors of a context share the
numbers that are drawn.  A context of more than ``MOST_ROWS`` rows of a detector is left to the row-wise form in
``resampling``, which gives the same values without holding a context in one task.

Two rules of drawing: ``portable`` hashes (seed, stream, replicate, stratum, place), which SQL can repeat; ``twister`` is the
Mersenne Twister seeded by the stream's number plus the replicate, whose one sequence serves the strata in sorted order, as
Python's ``random`` would draw them.

A unit may have several rows in its stratum (the videos of one source): all of them take its weight.  Units are sorted as
text.  Rows without a score take no part; contexts without rows give none.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A context with more rows isn't held in one task; ranges that the replicates are cut into; entries of a matrix at a time.
MOST_ROWS, RANGES, HELD = 1 << 20, 8, 1 << 18


def stream_number(seed: int, stream: str) -> int:
    """The first eight bytes of the SHA-256 of seed::stream, as a number."""
    return int.from_bytes(hashlib.sha256(f"{seed}::{stream}".encode()).digest()[:8], "big")


class Twister:
    """Raw 32-bit words of the Mersenne Twister after Python's seeding by an integer, and draws below n by rejection."""

    def __init__(self, number: int):
        number, digits = abs(number), []
        while number or not digits:
            digits.append(number & 0xFFFFFFFF)
            number >>= 32
        self.state = np.random.RandomState(digits)  # a list seeds by array, as Python does with integers
        self.words = np.zeros(0, np.uint32)

    def below(self, n: int, count: int) -> np.ndarray:
        """count draws from range(n); n has 32 bits at most."""
        if n <= 0 or n >= 1 << 32:
            raise ValueError("a draw needs between 1 and 2^32 - 1 units")
        shift = np.uint32(32 - n.bit_length())
        found, have = [], 0
        while have < count:
            if not len(self.words):
                self.words = self.state.randint(0, 1 << 32, size=max(64, 2 * (count - have)), dtype=np.uint32)
            own = self.words >> shift
            fits = np.flatnonzero(own < n)[: count - have]
            found.append(own[fits])
            have += len(fits)
            used = fits[-1] + 1 if have == count else len(own)  # rejected words after the last draw serve the next stratum
            self.words = self.words[used:]
        return np.concatenate(found).astype(np.int64)


_TURNS = [7, 12, 17, 22] * 4 + [5, 9, 14, 20] * 4 + [4, 11, 16, 23] * 4 + [6, 10, 15, 21] * 4
_SINES = [int(abs(math.sin(k + 1)) * 2**32) for k in range(64)]
_START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)
#: Digests at a time: few enough for a core's cache, enough that the calls of a round don't count.
AT_ONCE = 1 << 15
_MASK = 0xFFFFFFFF


def _which(k: int) -> int:
    """The word of a block that round k takes."""
    return (k, 5 * k + 1, 3 * k + 5, 7 * k)[k // 16] % 16


def _round(k: int, a: int, b: int, c: int, d: int, word: int) -> tuple[int, int, int, int]:
    """One round on numbers."""
    f = (d ^ (b & (c ^ d)), c ^ (d & (b ^ c)), b ^ c ^ d, c ^ (b | ~d & _MASK))[k // 16]
    f = f + a + _SINES[k] + word & _MASK
    return d, b + (f << _TURNS[k] | f >> 32 - _TURNS[k]) & _MASK, b, c


def _md5_of_words(words: list[int | np.ndarray], n: int) -> np.ndarray:
    """The first 32 bits of n MD5s, a round at a time over all of them.

    ``words`` are those of the padded texts, 16 a block: an array of n, or a number where all texts agree.  Rounds before the
    first word that differs are done once, and a sum of constants is added at once.
    """
    state, last = list(_START), len(words) - 16
    f, turned = np.empty(n, np.uint32), np.empty(n, np.uint32)
    for first in range(0, len(words), 16):
        own, begin = [x.copy() if isinstance(x, np.ndarray) else x for x in state], 0
        while begin < 64 and not any(isinstance(x, np.ndarray) for x in (*own, words[first + _which(begin)])):
            own = list(_round(begin, *own, words[first + _which(begin)]))
            begin += 1
        if begin < 64 or first == last:
            a, b, c, d = (np.full(n, x, np.uint32) if isinstance(x, int) else x for x in own)
            # what the last three rounds make of b, c and d isn't asked for: the head is what the 61st round made
            rounds = 61 if first == last and begin <= 61 else 64
            for k in range(begin, rounds):
                if k < 16:  # d ^ (b & (c ^ d))
                    np.bitwise_xor(c, d, out=f)
                    np.bitwise_and(f, b, out=f)
                    np.bitwise_xor(f, d, out=f)
                elif k < 32:  # c ^ (d & (b ^ c))
                    np.bitwise_xor(b, c, out=f)
                    np.bitwise_and(f, d, out=f)
                    np.bitwise_xor(f, c, out=f)
                elif k < 48:  # b ^ c ^ d
                    np.bitwise_xor(b, c, out=f)
                    np.bitwise_xor(f, d, out=f)
                else:  # c ^ (b | ~d)
                    np.bitwise_not(d, out=f)
                    np.bitwise_or(f, b, out=f)
                    np.bitwise_xor(f, c, out=f)
                word = words[first + _which(k)]
                np.add(f, a, out=f)
                if isinstance(word, np.ndarray):
                    np.add(f, word, out=f)
                    word = 0
                np.add(f, np.uint32(_SINES[k] + word & _MASK), out=f)
                np.left_shift(f, np.uint32(_TURNS[k]), out=turned)
                np.right_shift(f, np.uint32(32 - _TURNS[k]), out=f)
                np.bitwise_or(f, turned, out=f)
                np.add(f, b, out=f)
                a, b, c, d, f = d, f, b, c, a
            own = [b if rounds == 61 else a, b, c, d]
        state = [x + y if isinstance(x, np.ndarray) else x + y & _MASK for x, y in zip(own, state, strict=True)]
    return state[0].byteswap()


def md5_heads(texts: np.ndarray) -> np.ndarray:
    """The first 32 bits of the MD5 of each row of texts (bytes, all of one length)."""
    n, length = texts.shape
    padded = _padded(n, length)
    padded[:, :length], padded[:, length] = texts, 0x80
    return _md5_of_words(list(np.ascontiguousarray(padded.view("<u4").T).astype(np.uint32, copy=False)), n)


def _padded(n: int, length: int) -> np.ndarray:
    """Room for n texts of one length and what MD5 puts after them, of which the length is there."""
    size = (length + 8) // 64 * 64 + 64
    padded = np.zeros((n, size), np.uint8)
    padded[:, size - 8 :] = np.frombuffer((8 * length).to_bytes(8, "little"), np.uint8)
    return padded


def _by_width(stop: int) -> Iterator[tuple[int, np.ndarray]]:
    """The decimal digits of the numbers below stop as bytes, a matrix for each number of digits, and where it starts."""
    start, width = 0, 1
    while start < stop:
        numbers = np.arange(start, min(stop, 10**width), dtype=np.int64)
        yield start, np.stack([numbers // 10**p % 10 + 48 for p in range(width - 1, -1, -1)], 1).astype(np.uint8)
        start, width = 10**width, width + 1


def _ends(tail: np.ndarray, shift: int) -> np.ndarray:
    """The words of the texts' ends, which begin ``shift`` bytes into a word: a row a word."""
    n, width = tail.shape
    ends = np.zeros((n, (shift + width) // 4 * 4 + 4), np.uint8)
    ends[:, shift : shift + width], ends[:, shift + width] = tail, 0x80
    return np.ascontiguousarray(ends.view("<u4").T).astype(np.uint32, copy=False)


def portable_numbers(seed: int, stream: str, replicates: range, stratum: str, n: int) -> np.ndarray:
    """The first 32 bits of the MD5 of seed::stream::replicate::stratum::i: a row a replicate, a column for each i below n.

    The texts of a replicate differ in their last digits alone, so only the words with these are arrays.
    """
    out = np.empty((len(replicates), n), np.uint32)
    fronts = [f"{seed}::{stream}::{r}::{stratum}::".encode() for r in replicates]
    for column, tail in _by_width(n):
        m, width = tail.shape
        most, row, ends = max(1, AT_ONCE // m), 0, {}
        while row < len(fronts):  # replicates of one number of digits, several at a time where n is small
            front = len(fronts[row])
            own = [x for x in fronts[row : row + most] if len(x) == front]
            at, shift = divmod(front, 4)
            end = ends[shift] if shift in ends else ends.setdefault(shift, _ends(tail, shift))
            fixed = _padded(len(own), front + width)
            fixed[:, :front] = np.frombuffer(b"".join(own), np.uint8).reshape(len(own), front)
            fixed = fixed.view("<u4").T
            for k in range(0, m, AT_ONCE):
                here = min(AT_ONCE, m - k)
                words: list[int | np.ndarray] = [int(x[0]) if (x == x[0]).all() else np.repeat(x, here).astype(np.uint32, copy=False) for x in fixed]
                for j, x in enumerate(end[:, k : k + here]):
                    x = np.tile(x, len(own))
                    words[at + j] = x | (words[at + j] if isinstance(words[at + j], np.ndarray) else np.uint32(words[at + j]))
                out[row : row + len(own), column + k : column + k + here] = _md5_of_words(words, len(own) * here).reshape(len(own), here)
            row += len(own)
    return out


def counted(numbers: np.ndarray, n: int) -> np.ndarray:
    """How often each of n units was drawn, by replicate: the first n numbers of each row, divided by n."""
    places = (numbers[:, :n] % np.uint32(n)).astype(np.int64) + n * np.arange(len(numbers))[:, None]
    return np.bincount(places.ravel(), minlength=len(numbers) * n).reshape(len(numbers), n)


def drawn(rule: str, seed: int, stream: str, replicate: int, sizes: list[tuple[str, int]]) -> list[np.ndarray]:
    """For each stratum (name, number of units; sorted by name): how often each unit was drawn."""
    if rule == "twister":
        words = Twister(stream_number(seed, stream) + replicate)
        return [np.bincount(words.below(n, n), minlength=n) for _, n in sizes]
    return [counted(portable_numbers(seed, stream, range(replicate, replicate + 1), stratum, n), n)[0] for stratum, n in sizes]


def _parts(column: pa.ChunkedArray) -> dict[str, np.ndarray]:
    """The rows of each text of a column of few texts, sorted."""
    coded = column.combine_chunks().dictionary_encode()
    codes = coded.indices.to_numpy(zero_copy_only=False)
    return {name: np.flatnonzero(codes == k) for name, k in sorted((x, k) for k, x in enumerate(coded.dictionary.to_pylist()))}


class Strata:
    """The rows of one detector in a context: where each stratum's are, and which of its units, sorted as text, a row is of."""

    def __init__(self, table: pa.Table):
        self.rows, self.sizes = _parts(table.column("stratum")), []
        self.place = np.empty(len(table), np.int64)
        for s, own in self.rows.items():
            coded = table.column("unit").take(pa.array(own)).combine_chunks().dictionary_encode()
            rank = np.empty(len(coded.dictionary), np.int64)
            rank[pc.sort_indices(coded.dictionary).to_numpy()] = np.arange(len(rank))
            self.place[own] = rank[coded.indices.to_numpy()]
            self.sizes.append((s, len(rank)))


class Draws:
    """How often units were drawn in a block of replicates; numbers of the portable rule serve all detectors of a context."""

    def __init__(self, rule: str, seed: int, stream: str, strata: list[Strata]):
        self.rule, self.seed, self.stream = rule, seed, stream
        self.longest: dict[str, int] = {}
        for s, n in (x for own in strata for x in own.sizes):
            self.longest[s] = max(n, self.longest.get(s, 0))

    def start(self, block: range) -> None:
        self.block = block
        if self.rule != "twister":
            self.numbers = {s: portable_numbers(self.seed, self.stream, block, s, n) for s, n in self.longest.items()}

    def counts(self, own: Strata) -> dict[str, np.ndarray]:
        """For each stratum a row a replicate of the block, a column a unit."""
        if self.rule == "twister":
            each = [drawn(self.rule, self.seed, self.stream, r, own.sizes) for r in self.block]
            return {s: np.stack([x[k] for x in each]) for k, (s, _) in enumerate(own.sizes)}
        return {s: counted(self.numbers[s], n) for s, n in own.sizes}


class Histogram:
    """Rows of one group by score, for any matrix of their weights."""

    def __init__(self, scores: np.ndarray, labels: np.ndarray | None = None):
        self.by = np.argsort(scores, kind="stable")
        ordered = scores[self.by]
        self.first = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])) if len(scores) else np.zeros(0, np.int64)
        self.scores = ordered[self.first]

    def cuts(self, weights: np.ndarray, num: int = 5, den: int = 100) -> np.ndarray:
        """For each replicate the lowest of its scores with at most floor(n num / den) of the weight at or above it; the next
        double above its largest score if there is none.
        """
        w = np.add.reduceat(weights[:, self.by], self.first, axis=1)
        at_least = np.cumsum(w[:, ::-1], 1)[:, ::-1]
        within = (at_least <= (num * w.sum(1) // den)[:, None]) & (w > 0)
        top = self.scores[w.shape[1] - 1 - np.argmax(w[:, ::-1] > 0, 1)]
        return np.where(within.any(1), self.scores[np.argmax(within, 1)], np.nextafter(top, np.inf))


class Cells:
    """Rows of one detector by label, stratum and the metric groups that they belong to; a cell's rows are in the order of a
    score.  A group is some cells of each label, and its AUC the sum of what each pair of them has.
    """

    def __init__(self, strata: Strata, labels: np.ndarray, groups: dict[str, np.ndarray], scores: np.ndarray):
        self.members: dict[str, tuple[list[int], list[int]]] = {}
        self.cells, self.pairs = [], {}
        for joined, within in groups.items():
            names = joined.split(SEPARATOR) if joined else []
            for g in names:
                self.members.setdefault(g, ([], []))
            for s, own in strata.rows.items():
                both = np.intersect1d(own, within, assume_unique=True)
                for label in (0, 1):
                    mine = both[labels[both] == label]
                    if names and len(mine):
                        mine = mine[np.argsort(scores[mine], kind="stable")]
                        for g in names:
                            self.members[g][label].append(len(self.cells))
                        self.cells.append((s, strata.place[mine], scores[mine]))
        for real, fake in self.members.values():
            for p, q in ((p, q) for p in fake for q in real if (p, q) not in self.pairs):
                low, high = (np.searchsorted(self.cells[q][2], self.cells[p][2], side) for side in ("left", "right"))
                self.pairs[p, q] = low, high

    def metrics(self, counts: dict[str, np.ndarray], cuts: np.ndarray) -> Iterator[tuple[str, dict[str, np.ndarray]]]:
        """For each group AUC, FPR, FNR and HTER of each replicate at its cut; NaN where a class is empty."""
        rows, none = np.arange(len(cuts)), np.zeros(len(cuts), np.int64)
        weights = [np.take(counts[s], place, axis=1) for s, place, _ in self.cells]
        sums = [np.hstack([none[:, None], np.cumsum(w, axis=1)]) for w in weights]
        under = [c[rows, np.searchsorted(scores, cuts)] for c, (_, _, scores) in zip(sums, self.cells, strict=True)]
        twice = {}  # ranks of a pair's manipulated rows among its real ones, times two
        for (p, q), (low, high) in self.pairs.items():
            ranks = np.take(sums[q], low, axis=1)
            ranks += np.take(sums[q], high, axis=1)
            twice[p, q] = np.einsum("ij,ij->i", weights[p], ranks)
        for g, (real, fake) in sorted(self.members.items()):
            n_neg, n_pos = (sum((sums[k][:, -1] for k in own), none) for own in (real, fake))
            reject, miss = (sum((under[k] for k in own), none) for own in (real, fake))
            wins = sum((twice[p, q] for p in fake for q in real), none)
            with np.errstate(divide="ignore", invalid="ignore"):
                auc, fpr, fnr = wins / 2 / (n_pos * n_neg), (n_neg - reject) / n_neg, miss / n_pos
            yield g, {"auc": np.where(n_pos * n_neg > 0, auc, np.nan), "fpr": fpr, "fnr": fnr, "hter": (fpr + fnr) / 2}


#: Between the names of a row's metric groups.
SEPARATOR = "\x1f"


def _blocks(replicates: range, rows: int) -> Iterator[range]:
    step = max(1, HELD // max(1, rows))
    for k in range(replicates.start, replicates.stop, step):
        yield range(k, min(k + step, replicates.stop))


def _ranged(rows: DataFrame, replicates: int) -> tuple[DataFrame, int]:
    """rows once a range of replicates, and how many replicates a range has."""
    width = -(-replicates // min(RANGES, replicates))
    return rows.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(-(-replicates // width) - 1)))), width


def dealt(rows: DataFrame, keys: list[str]) -> DataFrame:
    """rows by their groups over a fixed number of tasks: the work goes by replicates, so few bytes mustn't mean few tasks."""
    spark = rows.sparkSession
    return rows.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 6 * spark.sparkContext.defaultParallelism), *keys)


def _fields(rows: DataFrame, keys: list[str]) -> list[T.StructField]:
    return [rows.schema[k] for k in keys]


def _table(keys: list[str], head: pa.Table, columns: dict[str, pa.Array], n: int) -> pa.Table:
    same = {k: pa.repeat(head.column(k)[0], n) for k in keys}
    return pa.table(same | columns)


def _detectors(table: pa.Table) -> dict[str, pa.Table]:
    return {d: table.take(pa.array(own)) for d, own in _parts(table.column("detector")).items()}


def operating_points(rows: DataFrame, context: list[str], scores: dict[str, str], replicates: int, seed: int, stream: str, rule: str = "portable") -> DataFrame:
    """context, replicate and for each of ``scores`` (result column to score column) the operating point in each replicate.

    ``rows`` has context (detector among it), stratum, unit and the score columns, all of them real videos.
    """
    parts, width = _ranged(rows.select(*context, "stratum", F.col("unit").cast("string").alias("unit"), *set(scores.values())), replicates)
    shared = [*(k for k in context if k != "detector"), "part"]

    def run(table: pa.Table) -> pa.Table:
        first = table.column("part")[0].as_py() * width
        mine = range(first, min(first + width, replicates))
        own = _detectors(table)
        strata = {d: Strata(t) for d, t in own.items()}
        forms = {(d, name): Histogram(t.column(c).to_numpy()) for d, t in own.items() for name, c in scores.items()}
        draws, out = Draws(rule, seed, stream, list(strata.values())), {k: [] for k in forms}
        for block in _blocks(mine, max(map(len, own.values()))):
            draws.start(block)
            for d, t in own.items():
                counts, weights = draws.counts(strata[d]), np.empty((len(block), len(t)), np.int64)
                for s, rows_of in strata[d].rows.items():
                    weights[:, rows_of] = counts[s][:, strata[d].place[rows_of]]
                for name in scores:
                    out[d, name].append(forms[d, name].cuts(weights))
        numbers = {"replicate": pa.array(list(mine), pa.int32())}
        return pa.concat_tables([_table(context, t, numbers | {name: pa.array(np.concatenate(out[d, name])) for name in scores}, len(mine)) for d, t in own.items()])

    schema = T.StructType([*_fields(rows, context), T.StructField("replicate", T.IntegerType()), *(T.StructField(n, T.DoubleType()) for n in scores)])
    return dealt(parts, shared).groupBy(*shared).applyInArrow(run, schema)


def group_metrics(rows: DataFrame, context: list[str], scores: dict[str, str], cuts: DataFrame, replicates: int, seed: int, stream: str, rule: str = "portable") -> DataFrame:
    """context, metric_group, replicate and for each prefix of ``scores`` (prefix to score column) its auc, fpr, fnr and hter.

    ``rows`` has context (detector among it), stratum, unit, study_label, groups (the metric groups that a row belongs to) and
    the score columns; ``cuts`` has detector, replicate, threshold_value.  One draw a replicate serves all groups and all score
    columns.
    """
    own = rows.select(*context, "stratum", F.col("unit").cast("string").alias("unit"), "study_label", F.coalesce(F.array_join("groups", SEPARATOR), F.lit("")).alias("groups"), *set(scores.values()))
    parts, width = _ranged(own, replicates)
    shared = [k for k in context if k != "detector"]
    fresh = [f"_{k}" for k in shared]  # names of their own, as both sides come from the same rows
    held = rows.select(*shared).distinct().toDF(*fresh)
    at = cuts.withColumn("_part", F.floor(F.col("replicate") / width).cast("int")).crossJoin(held).select(*fresh, "_part", "detector", "replicate", "threshold_value")
    names = [f"{prefix}{m}" for prefix in scores for m in ("auc", "fpr", "fnr", "hter")]

    def run(table: pa.Table, points: pa.Table) -> pa.Table:
        if not len(table) or not len(points):
            return empty
        cut = {d: t.sort_by("replicate") for d, t in _detectors(points).items()}
        own = {d: t for d, t in _detectors(table).items() if d in cut}
        if not own:
            return empty
        first = table.column("part")[0].as_py() * width
        mine = range(first, min(first + width, replicates))
        strata, forms = {d: Strata(t) for d, t in own.items()}, {}
        for d, t in own.items():
            labels, groups = t.column("study_label").to_numpy(), _parts(t.column("groups"))
            forms |= {(d, c): Cells(strata[d], labels, groups, t.column(c).to_numpy()) for c in set(scores.values())}
        heads, draws, found = {d: t.slice(0, 1) for d, t in own.items()}, Draws(rule, seed, stream, list(strata.values())), []
        del table
        for block in _blocks(mine, max(map(len, own.values()))):
            draws.start(block)
            for d in own:
                here = cut[d].column("threshold_value").to_numpy()[block.start - first : block.stop - first]
                counts, columns = draws.counts(strata[d]), {}
                for prefix, c in scores.items():
                    for g, got in forms[d, c].metrics(counts, here):
                        columns.setdefault(g, {}).update({f"{prefix}{m}": pa.array(v, pa.float64(), from_pandas=True) for m, v in got.items()})
                for g, values in columns.items():
                    fixed = {"metric_group": pa.array([g] * len(block)), "replicate": pa.array(list(block), pa.int32())}
                    found.append(_table(context, heads[d], fixed | values, len(block)))
        return pa.concat_tables(found).select(empty.column_names)

    schema = T.StructType([*_fields(rows, context), T.StructField("metric_group", T.StringType()), T.StructField("replicate", T.IntegerType()), *(T.StructField(n, T.DoubleType()) for n in names)])
    from pyspark.sql.pandas.types import to_arrow_schema

    empty = to_arrow_schema(schema).empty_table()
    left, right = dealt(parts, [*shared, "part"]), dealt(at, [*fresh, "_part"])
    return left.groupBy(*shared, "part").cogroup(right.groupBy(*fresh, "_part")).applyInArrow(run, schema)


def unit_counts(sizes: DataFrame, context: list[str], replicates: int, seed: int, stream: str) -> DataFrame:
    """context, stratum, replicate, k, w: how often each place below n was drawn by the portable rule, for strata of n units
    (columns context, stratum, n).  A task takes one block of replicates of a stratum after the other.
    """
    step = F.greatest(F.lit(1), F.floor(F.lit(HELD) / F.col("n"))).cast("int")
    each = sizes.withColumn("step", step).withColumn("first", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1), F.col("step"))))
    schema = T.StructType([*_fields(sizes, context), T.StructField("stratum", T.StringType()), T.StructField("replicate", T.IntegerType()), T.StructField("k", T.IntegerType()), T.StructField("w", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = pa.Table.from_batches([batch.slice(i, 1)])
                first, step, n, stratum = (row.column(c)[0].as_py() for c in ("first", "step", "n", "stratum"))
                block = range(first, min(first + step, replicates))
                weights = counted(portable_numbers(seed, stream, block, stratum, n), n)
                r, k = np.nonzero(weights)
                columns = {"replicate": pa.array((r + first).astype(np.int32)), "k": pa.array(k.astype(np.int32)), "w": pa.array(weights[r, k])}
                yield from _table([*context, "stratum"], row, columns, len(k)).to_batches()

    return dealt(each, [*context, "stratum", "first"]).mapInArrow(run, schema)


def draw_counts(rows: DataFrame, context: list[str], replicates: int, seed: int, stream: str, rule: str = "twister") -> DataFrame:
    """context, stratum, replicate, unit, w: the units that each replicate drew, and how often."""
    parts, width = _ranged(rows.select(*context, "stratum", F.col("unit").cast("string").alias("unit")).distinct(), replicates)

    def run(table: pa.Table) -> pa.Table:
        first = table.column("part")[0].as_py() * width
        mine = range(first, min(first + width, replicates))
        table = table.sort_by([("stratum", "ascending"), ("unit", "ascending")])
        own = Strata(table)
        draws, found = Draws(rule, seed, stream, [own]), []
        for block in _blocks(mine, len(table)):
            draws.start(block)
            for s, weights in draws.counts(own).items():
                r, k = np.nonzero(weights)  # a unit is one row here, so its place is that in the sorted stratum
                columns = {"stratum": pa.array([s] * len(k), pa.string()), "replicate": pa.array((r + block.start).astype(np.int32)), "unit": table.column("unit").take(pa.array(own.rows[s][k])), "w": pa.array(weights[r, k].astype(np.int64))}
                found.append(_table(context, table, columns, len(k)))
        return pa.concat_tables(found)

    schema = T.StructType([*_fields(rows, context), T.StructField("stratum", T.StringType()), T.StructField("replicate", T.IntegerType()), T.StructField("unit", T.StringType()), T.StructField("w", T.LongType())])
    return dealt(parts, [*context, "part"]).groupBy(*context, "part").applyInArrow(run, schema)
