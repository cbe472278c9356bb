"""Choosing rows: preferred, latest, largest, evenly spaced, greedy."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema


def first_by(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in the given order."""
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_r = 1").drop("_r")


def top_k(rows: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    """The first k rows of each key, numbered from 1 (column place)."""
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("place") <= k)


def latest(rows: DataFrame, keys: list[str], sequence: str) -> DataFrame:
    """The row with the largest sequence of each key, without a sort."""
    others = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*others), sequence).alias("r")).select(*keys, *(F.col(f"r.{c}").alias(c) for c in others))


def round_robin(rows: DataFrame, role: str, group: str, views: int = 4) -> DataFrame:
    """Sorted groups of a role dealt to the views in turn."""
    return rows.withColumn("view", F.pmod(F.dense_rank().over(Window.partitionBy(role).orderBy(group)) - 1, F.lit(views)))


def strided(rows: DataFrame, keys: list[str], order: str, k: int) -> DataFrame:
    """Every (n div k)-th row of a key, k rows at most."""
    inside = Window.partitionBy(*keys)
    idx = rows.withColumns({"idx": F.row_number().over(inside.orderBy(order)) - 1, "n": F.count("*").over(inside)})
    step = F.greatest(F.expr(f"n div {k}"), F.lit(1))
    return idx.where((F.pmod("idx", step) == 0) & (F.floor(F.col("idx") / step) < k)).drop("n")


def running_best(rows: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """Whether a value is strictly larger than all before it (column improved)."""
    before = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    best = F.max(value).over(before)
    return rows.withColumns({"best_before": best, "improved": best.isNull() | (F.col(value) > best)})


def case_identity(label: str = "label", source: str = "source", subset: str = "subset", id_: str = "video") -> Column:
    """Reals are one case a source, fakes one a subset and id."""
    return F.when(F.col(label) == 0, F.concat_ws("::", F.lit("real"), F.col(source).cast("string"))).otherwise(F.concat_ws("::", F.lit("fake"), F.coalesce(F.col(subset).cast("string"), F.lit("")), F.col(id_).cast("string")))


def greedy_cases(rows: DataFrame, classes: list[tuple[str, Column, str, bool]], identity: str, k: int, scope: list[str] | None = None, tie: str = "video") -> DataFrame:
    """For each class in turn, the k best rows whose identity no earlier class took, one an identity: scope, identity, tie,
    case_class, place.

    A class is (name, predicate, metric, ascending); ascending reverses the tie-break too, nulls come last.  Earlier classes
    take at most k identities each, so a class needs no more than its k x classes best: these lists are cut by limits that
    apply before the shuffle, and only they are resolved one class after the other, in one task a scope.
    """
    scope = scope or []
    rank, order = {n: i for i, (n, _, _, _) in enumerate(classes)}, {n: asc for n, _, _, asc in classes}
    cells = [F.when(p, F.struct(F.lit(n).alias("case_class"), (F.col(m) if asc else -F.col(m)).cast("double").alias("metric"), F.col(tie).cast("long").alias("tie"))) for n, p, m, asc in classes]
    each = rows.select(*scope, F.col(identity).cast("string").alias("_identity"), F.explode(F.filter(F.array(*cells), lambda x: x.isNotNull())).alias("c")).select(*scope, "_identity", "c.case_class", "c.metric", "c.tie")
    down = F.col("case_class").isin([n for n, asc in order.items() if not asc])
    each = each.withColumn("_turn", F.when(down, -F.col("tie")).otherwise(F.col("tie")))
    best = each.groupBy(*scope, "case_class", "_identity").agg(F.min(F.struct(F.col("metric").isNull().alias("none"), "metric", "_turn", "tie")).alias("b"))
    listed = Window.partitionBy(*scope, "case_class").orderBy("b", "_identity")
    few = best.withColumn("_r", F.row_number().over(listed)).where(F.col("_r") <= k * len(classes))

    def resolve(table: pa.Table) -> pa.Table:
        taken, out = set(), []
        held = sorted(table.to_pylist(), key=lambda r: (rank[r["case_class"]], r["_r"]))
        for name in rank:
            own = [r for r in held if r["case_class"] == name and r["_identity"] not in taken][:k]
            taken |= {r["_identity"] for r in own}
            out += [{**{c: r[c] for c in scope}, "identity": r["_identity"], tie: r["b"]["tie"], "case_class": name, "place": i + 1} for i, r in enumerate(own)]
        return pa.Table.from_pylist(out, schema)

    fields = T.StructType([*(few.schema[c] for c in scope), T.StructField("identity", T.StringType()), T.StructField(tie, T.LongType()), T.StructField("case_class", T.StringType()), T.StructField("place", T.LongType())])
    schema = to_arrow_schema(fields)
    return few.groupBy(*scope).applyInArrow(resolve, fields)


def hash_sample(rows: DataFrame, keys: list[str], id_: str, seed: int, k: Column) -> DataFrame:
    """k rows of each key in the order of an md5 of seed and id (column k_of is the place)."""
    order = F.md5(F.concat_ws("::", F.lit(str(seed)), F.col(id_).cast("string")))
    return rows.withColumn("k_of", F.row_number().over(Window.partitionBy(*keys).orderBy(order, id_))).where(F.col("k_of") <= k)


def hold_out_size(n: Column, share: float, least: int) -> Column:
    """round-half-even(n share), at least ``least``, both sides kept non-empty."""
    return F.least(F.greatest(F.bround(n * share, 0).cast("long"), F.lit(least)), n - 1)


def exposures(rows: DataFrame, keys: list[str], id_: str, seed: int, target: int) -> DataFrame:
    """Each item once, then hash-ordered reuse, until a key has ``target`` exposures."""
    n = F.count("*").over(Window.partitionBy(*keys))
    passes = rows.withColumn("n", n).withColumn("pass", F.explode(F.sequence(F.lit(0), F.ceil(F.lit(target) / F.col("n")).cast("int"))))
    order = F.md5(F.concat_ws("::", F.lit(str(seed)), F.col("pass").cast("string"), F.col(id_).cast("string")))
    return passes.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy("pass", order, id_))).where(F.col("place") <= target).drop("n")


def largest(rows: DataFrame, keys: list[str], size: str, order: str) -> DataFrame:
    """The row of each key with the largest size, of those that tie the first in a numeric order, without a sort."""
    others = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*others), F.struct(F.col(size), -F.col(order))).alias("r")).select(*keys, *(F.col(f"r.{c}").alias(c) for c in others))


def scored(rows: DataFrame, score: str = "score", available: str = "score_available") -> DataFrame:
    """Records in text form that have a score and don't say that it isn't available; the score becomes a number.

    Blank and ``null`` are no score; a text that is no number is an error.  A missing column ``available`` says yes, a null no.
    """
    text = F.trim(score)
    number = F.when(~F.lower(text).isin("", "null"), text).cast("double")
    there = F.lower(F.trim(F.col(available).cast("string"))).isin("1", "true", "yes", "y") if available in rows.columns else F.lit(True)
    return rows.where(there).withColumn(score, number).where(F.col(score).isNotNull())
