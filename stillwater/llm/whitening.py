"""Whitening of embeddings by a compensated covariance.

Entries become whole numbers x.  Sums are exact, so n * x - S, the centred vector times n, is exact as well.  Its outer
products are accumulated in double-double: products and sums keep their rounding errors (error-free transformations), rows of
a batch are added in pairs of halves, and tasks send their high and low parts, which are merged in rounds of ``FAN`` tasks.  The
driver gets one matrix of the dimension's size and solves it by ``eigen``.

Rows whose vector is null or has a null or non-finite entry are left out, as are those with an entry that gives no
64-bit number, and vectors of another length than the commonest (of equally common ones, the longest): they have no place in
one covariance.  Rows that repeat or lack a vec_id count each.  Components without variance (of constant or fewer vectors
than dimensions) have a null ``whitened``, and ``identity_error`` is over the others; it is null where there are none.  A
``deviation`` beyond 64 bits is null; ``deviation_exact`` always has its digits.  Without rows the result is empty.
Other columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stillwater.llm import common
from stillwater.llm.eigen import EPS, eigen

SCALE, SHIFT = 1024, 100_000
COMPONENTS = 8
#: Tasks whose parts are merged together, entries of the matrix in one row, and products that are held at a time.
FAN, BLOCK, HELD = 64, 4096, 1 << 17
_SPLIT = 134217729.0  # 2^27 + 1
_BITS = 31


@dataclass
class Fit:
    n: int
    sums: list[int]  # by dimension
    vectors: np.ndarray  # a column a component
    values: np.ndarray  # eigenvalues of the covariance
    trace: float


def two_sum(a, b):
    s = a + b
    t = s - a
    return s, (a - (s - t)) + (b - t)


def halves(a):
    t = _SPLIT * a
    high = t - (t - a)
    return high, a - high


def add(a_hi, a_lo, b_hi, b_lo):
    """Sum of two double-doubles."""
    s, e = two_sum(a_hi, b_hi)
    t, f = two_sum(a_lo, b_lo)
    e = e + t
    s, e = s + e, e - ((s + e) - s)
    e = e + f
    return s + e, e - ((s + e) - s)


def products(hi: np.ndarray, lo: np.ndarray, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Double-double sums over rows of v[i] * v[j], where v = hi + lo."""
    h, t = halves(hi)
    p = hi[:, i] * hi[:, j]
    e = ((h[:, i] * h[:, j] - p) + h[:, i] * t[:, j] + t[:, i] * h[:, j]) + t[:, i] * t[:, j]
    if lo.any():
        e = e + (hi[:, i] * lo[:, j] + lo[:, i] * hi[:, j])
    while len(p) > 1:
        m = len(p) // 2
        s, r = add(p[:m], e[:m], p[m : 2 * m], e[m : 2 * m])
        p, e = np.concatenate([s, p[2 * m :]]), np.concatenate([r, e[2 * m :]])
    return p[0], e[0]


def whole(batch: pa.RecordBatch) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Of a batch (vec_id, vector): by length, the places of the rows that take part and their x as int64."""
    column = batch.column(1)
    length = np.array(column.value_lengths().fill_null(-1))
    ends = np.cumsum(np.maximum(length, 0))
    raw = np.array(column.flatten().cast(pa.float64()).fill_null(np.nan))
    with np.errstate(over="ignore", invalid="ignore"):
        scaled = np.floor(raw * SCALE)
        fits = np.abs(scaled) < 2.0**62  # false for NaN and infinities
    bad = np.concatenate([[0], np.cumsum(~fits)])
    good = (length >= 0) & (bad[ends] == bad[ends - np.maximum(length, 0)])
    values = np.where(fits, scaled, 0).astype(np.int64) + SHIFT
    out = {}
    for d in np.unique(length[good]).tolist():
        rows = np.flatnonzero(good & (length == d))
        out[d] = rows, values[(ends[rows] - d)[:, None] + np.arange(d)]
    return out


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n * x - S exactly: int64 where that has room, else Python's integers."""
    most = max(int(np.abs(x).max(initial=0)), SHIFT)
    if 2 * n * most < 1 << 62 and max(map(abs, sums), default=0) < 1 << 61:
        return n * x - np.array(sums, np.int64)
    return n * x.astype(object) - np.array(sums, object)


def parts(y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whole numbers as double-doubles."""
    hi = y.astype(np.float64)
    if y.dtype == object:
        return hi, np.array([[float(a - int(b)) for a, b in zip(u, v, strict=True)] for u, v in zip(y, hi, strict=True)]).reshape(y.shape)
    return hi, (y - hi.astype(np.int64)).astype(np.float64)


def squares(y: np.ndarray) -> list[int]:
    """The exact sum of squares of each row, by two parts of each number where int64 has no room."""
    most = int(np.abs(y).max(initial=0))
    d = max(1, y.shape[1])
    if y.dtype != object and most * most * d < 1 << 63:
        return (y * y).sum(1).tolist()
    if y.dtype != object and most < 1 << 46 and d <= 1 << 14:
        a, b = y >> 23, y & ((1 << 23) - 1)
        return [(s << 46) + (t << 24) + u for s, t, u in zip((a * a).sum(1).tolist(), (a * b).sum(1).tolist(), (b * b).sum(1).tolist(), strict=True)]
    return [sum(v * v for v in row) for row in y.tolist()]


def exact_sums(vectors: DataFrame, scratch: common.Scratch) -> tuple[int, list[int]]:
    """How many vectors take part, and their exact sums by dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for d, (rows, x) in whole(batch).items():
                high, low = (x >> _BITS).sum(0), (x & ((1 << _BITS) - 1)).sum(0)  # a batch has far fewer than 2^31 rows
                yield pa.RecordBatch.from_arrays([pa.array([d], pa.int32()), pa.array([len(rows)], pa.int64()), pa.array([high.tolist()], pa.list_(pa.int64())), pa.array([low.tolist()], pa.list_(pa.int64()))], names=["d", "n", "high", "low"])

    found = scratch.table(vectors.mapInArrow(run, "d int, n long, high array<long>, low array<long>"), "sums")
    most = found.groupBy("d").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    if most is None:
        return 0, []
    each = found.where(F.col("d") == most["d"]).select(F.posexplode(F.arrays_zip("high", "low")).alias("place", "x"))
    total = each.groupBy("place").agg(*(F.sum(F.col(f"x.{c}").cast("decimal(38,0)")).alias(c) for c in ("high", "low")))
    return most["n"], [(int(r["high"]) << _BITS) + int(r["low"]) for r in sorted(total.collect(), key=lambda r: r["place"])]


def covariance(vectors: DataFrame, n: int, sums: list[int], scratch: common.Scratch) -> tuple[np.ndarray, np.ndarray]:
    """The outer products of n * x - S, summed over all vectors: high and low parts of the matrix."""
    d = len(sums)
    i, j = np.triu_indices(d)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hi, lo, seen = np.zeros(len(i)), np.zeros(len(i)), False
        step = max(1, HELD // max(1, len(i)))
        for batch in batches:
            for y in [centred(x, n, sums) for size, (_, x) in whole(batch).items() if size == d]:
                y_hi, y_lo = parts(y)
                for k in range(0, len(y), step):
                    hi, lo = add(hi, lo, *products(y_hi[k : k + step], y_lo[k : k + step], i, j))
                    seen = True
        if seen:
            task = TaskContext.get().partitionId()
            for k in range(0, len(i), BLOCK):
                yield _part(k // BLOCK, task, hi[k : k + BLOCK], lo[k : k + BLOCK])

    def merged(table: pa.Table) -> pa.Table:
        table = table.sort_by("task")
        hi, lo = (np.array(table.column(c).to_pylist()) for c in ("hi", "lo"))
        a, b = hi[0], lo[0]
        for k in range(1, len(hi)):
            a, b = add(a, b, hi[k], lo[k])
        return pa.Table.from_batches([_part(table.column("block")[0].as_py(), table.column("task")[0].as_py() // FAN, a, b)])

    schema = "block int, task int, hi array<double>, lo array<double>"
    found, k = scratch.table(vectors.mapInArrow(run, schema), "parts-0"), 0
    while (found.agg(F.max("task")).first()[0] or 0) > 0:  # one more round for each factor of FAN in the number of tasks
        k += 1
        found = scratch.table(found.groupBy("block", F.expr(f"task div {FAN}")).applyInArrow(merged, schema), f"parts-{k}")
    out = np.zeros((2, d, d))
    rows = sorted(found.collect(), key=lambda r: r["block"])
    for part, name in enumerate(("hi", "lo")):
        out[part, i, j] = out[part, j, i] = np.concatenate([r[name] for r in rows])
    return out[0], out[1]


def _part(block: int, task: int, hi: np.ndarray, lo: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([task], pa.int32()), pa.array([hi.tolist()], pa.list_(pa.float64())), pa.array([lo.tolist()], pa.list_(pa.float64()))], names=["block", "task", "hi", "lo"])


def fit(vectors: DataFrame, scratch: common.Scratch, components: int = COMPONENTS) -> Fit | None:
    """The principal components of vectors (vec_id, vector); None without any that has a dimension."""
    n, sums = exact_sums(vectors, scratch)
    if not n or not sums:
        return None
    hi, lo = covariance(vectors, n, sums, scratch)
    values, basis = eigen(hi + lo)
    scale = float(n)
    values, trace = values / scale / scale / scale, float(np.trace(hi) + np.trace(lo)) / scale / scale / scale
    return Fit(n, sums, np.ascontiguousarray(basis[:, :components]), values[:components], trace)


def transform(vectors: DataFrame, model: Fit) -> DataFrame:
    """vec_id, deviation, deviation_exact, whitened (an array by component) of the vectors that take part."""
    shared = vectors.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        some = _with_variance(own)
        weights = np.where(some, 1 / np.sqrt(np.where(some, own.values, 1)), np.nan)
        for batch in batches:
            for size, (rows, x) in whole(batch).items():
                if size != len(own.sums):
                    continue
                y = centred(x, own.n, own.sums)
                hi, lo = parts(y)
                white = ((hi / own.n + lo / own.n) @ own.vectors) * weights
                exact = squares(y)
                column = pa.array(white.ravel(), pa.float64(), from_pandas=True)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * white.shape[1], pa.int32()), column)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), pa.array([e if e < 1 << 63 else None for e in exact], pa.int64()), pa.array(map(str, exact), pa.string()), lists], names=["vec_id", "deviation", "deviation_exact", "whitened"])

    return vectors.mapInArrow(run, "vec_id long, deviation long, deviation_exact string, whitened array<double>")


def _with_variance(model: Fit) -> np.ndarray:
    """Components whose variance is more than what rounding leaves."""
    return model.values > len(model.sums) * EPS * max(model.trace, 0.0)


def identity_error(white: DataFrame, model: Fit) -> float | None:
    """The largest difference between the covariance of whitened vectors and the identity, centred before multiplying."""
    some = np.flatnonzero(_with_variance(model)).tolist()
    if not some:
        return None
    w = [F.get("whitened", F.lit(k)) for k in some]
    means = white.agg(*(F.avg(c).alias(f"m{k}") for k, c in enumerate(w))).first()
    centre = [c - F.lit(m) for c, m in zip(w, means, strict=True)]
    pairs = [(a, b) for a in range(len(w)) for b in range(a, len(w))]
    found = white.agg(*(F.avg(centre[a] * centre[b]).alias(f"c{a}_{b}") for a, b in pairs)).first()
    return max(abs(v - (a == b)) for v, (a, b) in zip(found, pairs, strict=True))


def whiten(embeddings: DataFrame, components: int = COMPONENTS, column: str = "embedding") -> DataFrame:
    """One row a vector and component: vec_id, component, n, deviation, whitened, explained, identity_error, deviation_exact."""
    spark = common.prepare(embeddings.sparkSession)
    scratch = common.Scratch(spark, "whitening")
    vectors = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col(column).cast("array<double>").alias("vector"))
    model = fit(vectors, scratch, components)
    if model is None:
        return spark.createDataFrame([], "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double, deviation_exact string")
    white = scratch.table(transform(vectors, model), "whitened")
    error = identity_error(white, model)
    shares = [float(v / model.trace) if model.trace > 0 else 0.0 for v in model.values]
    rows = white.select("vec_id", "deviation", "deviation_exact", F.posexplode(F.arrays_zip("whitened", F.array(*map(F.lit, shares)).alias("explained"))).alias("k", "w"))
    return rows.select("vec_id", (F.col("k") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", F.col("w.whitened").alias("whitened"), F.col("w.explained").alias("explained"), F.lit(error).cast("double").alias("identity_error"), "deviation_exact")
