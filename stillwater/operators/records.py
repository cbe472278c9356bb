"""Contracts of records: named rules, one row a broken rule."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def violations(rows: DataFrame, rules: dict[str, Column | str], keys: list[str]) -> DataFrame:
    """keys and rule, a row for each rule that a row breaks; a rule that is null counts as broken.  One pass, no shuffle."""
    tests = [(name, F.expr(rule) if isinstance(rule, str) else rule) for name, rule in rules.items()]
    broken = F.array(*(F.when(~F.coalesce(rule, F.lit(False)), F.lit(name)) for name, rule in tests))
    return rows.select(*keys, F.explode(F.filter(broken, lambda x: x.isNotNull())).alias("rule"))


def group_violations(rows: DataFrame, group: list[str], rules: dict[str, str], **aggregates: Column) -> DataFrame:
    """group and rule, for rules over the aggregates of each group."""
    return violations(rows.groupBy(*group).agg(*(c.alias(n) for n, c in aggregates.items())), rules, group)


def two_sided(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """keys and side: rows of one bag that the other lacks, as often as they are missing."""
    a, b = left.select(*keys), right.select(*keys)
    return a.exceptAll(b).withColumn("side", F.lit("left")).unionByName(b.exceptAll(a).withColumn("side", F.lit("right")))


def unmatched_counts(found: DataFrame, expected: DataFrame, keys: list[str]) -> DataFrame:
    """keys, n, expected where the counts differ; a key that one side lacks counts 0 there."""
    joined = found.select(*keys, F.col("n")).join(expected.select(*keys, F.col("n").alias("expected")), keys, "full")
    return joined.select(*keys, F.coalesce("n", F.lit(0)).cast("long").alias("n"), F.coalesce("expected", F.lit(0)).cast("long").alias("expected")).where("n <> expected")


def self_reversed_repeated(pairs: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Faults of a pair list: item and rule (self_pair, reversed_duplicate, repeated_id)."""
    own = pairs.where(F.col(a) == F.col(b)).select(F.col(a).cast("string").alias("item"), F.lit("self_pair").alias("rule"))
    key = F.concat_ws("_", F.least(a, b).cast("string"), F.greatest(a, b).cast("string")).alias("item")
    twice = pairs.where(F.col(a) != F.col(b)).groupBy(key).agg(F.countDistinct(F.col(a) < F.col(b)).alias("n")).where("n > 1").select("item", F.lit("reversed_duplicate").alias("rule"))
    ids = pairs.select(F.explode(F.array(F.col(a).cast("string"), F.col(b).cast("string"))).alias("item")).groupBy("item").count().where("count > 1").select("item", F.lit("repeated_id").alias("rule"))
    return own.distinct().unionByName(twice).unionByName(ids)
