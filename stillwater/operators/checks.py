"""Data-quality checks.  Each returns the rows that violate it: none means passed."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def repeated_keys(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def not_constant(rows: DataFrame, keys: list[str], column: str) -> DataFrame:
    """Keys with several values of a column."""
    return rows.groupBy(*keys).agg(F.countDistinct(column).alias("n_values")).where("n_values > 1")


def wrong_counts(rows: DataFrame, expected: DataFrame, keys: list[str]) -> DataFrame:
    """Keys whose count isn't the expected n, on either side."""
    seen = rows.groupBy(*keys).agg(F.count("*").alias("found"))
    return expected.join(seen, keys, "full").where(~F.col("found").eqNullSafe(F.col("n")))


def unmatched(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Keys of one side alone (column side)."""
    a, b = left.select(*keys).distinct(), right.select(*keys).distinct()
    return a.join(b, keys, "left_anti").withColumn("side", F.lit("left")).unionByName(b.join(a, keys, "left_anti").withColumn("side", F.lit("right")))


def differing(left: DataFrame, right: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """Rows of both sides whose fields differ, null-safely (column field)."""
    r = right.select(*keys, *(F.col(f).alias(f"_{f}") for f in fields))
    bad = F.filter(F.array(*(F.when(~F.col(f).eqNullSafe(F.col(f"_{f}")), f) for f in fields)), lambda x: x.isNotNull())
    return left.join(r, keys).select(*keys, F.explode(bad).alias("field"))


def broken(rows: DataFrame, rule: Column, keys: list[str]) -> DataFrame:
    """Rows for which a rule is false or unknown."""
    return rows.where(~F.coalesce(rule, F.lit(False))).select(*keys)


def leaking(rows: DataFrame, ids: list[str], split: str) -> DataFrame:
    """Ids that stand in several splits, wherever among the id columns they stand."""
    each = rows.select(split, F.explode(F.array_distinct(F.array(*ids))).alias("id"))
    return each.groupBy("id").agg(F.countDistinct(split).alias("n_splits")).where("n_splits > 1")


def audit(checks: dict[str, DataFrame]) -> DataFrame:
    """check, violations."""
    return reduce(DataFrame.unionByName, [df.groupBy().agg(F.lit(name).alias("check"), F.count("*").alias("violations")) for name, df in checks.items()])


def wrong_decisions(rows: DataFrame, keys: list[str], score: str = "video_score", threshold: str = "threshold_value", decision: str = "decision") -> DataFrame:
    """keys, stated, computed: decisions that score and threshold don't give; none is right where either is null."""
    computed = (F.col(score) >= F.col(threshold)).cast("int")
    return rows.select(*keys, F.col(decision).alias("stated"), computed.alias("computed")).where(~F.col("stated").eqNullSafe(F.col("computed")))


def identities(rows: DataFrame, keys: list[str], fields: list[str], position: str) -> DataFrame:
    """keys and rule: a row for each field with several values in a group (null counts as an empty text), and one, named by
    the position, where rows of a group share a position.  Least and greatest values tell, so no row is copied a field.
    """
    texts = {f: F.coalesce(F.col(f).cast("string"), F.lit("")) for f in fields}
    ends = [c for f, t in texts.items() for c in (F.min(t).alias(f"_a_{f}"), F.max(t).alias(f"_b_{f}"))]
    g = rows.groupBy(*keys).agg(*ends, (F.count("*") - F.countDistinct(position)).alias("_again"))
    broken = [F.when(F.col(f"_a_{f}") != F.col(f"_b_{f}"), F.lit(f)) for f in fields] + [F.when(F.col("_again") > 0, F.lit(position))]
    return g.select(*keys, F.explode(F.filter(F.array(*broken), lambda x: x.isNotNull())).alias("rule"))
