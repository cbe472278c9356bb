"""An audit of a chain of artifacts: many named rules a table in one pass, and hashes that tie each artifact to its source.

Row rules are counted while the artifact is written (``DataFrame.observe``), so the rules of an artifact cost no scan of their
own.  Rules over keys share one aggregation a key.  A rule that is null counts as broken.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: Bits of a row's hash that are summed; sums of 2^31 rows fit in a long.
HASH_DIGITS = 8


@dataclass
class Audit:
    """Counts of checks: name, rows (or keys) looked at, violations."""

    spark: SparkSession
    found: list[tuple[str, int, int]] = field(default_factory=list)
    scans: int = 0

    def written(self, df: DataFrame, path: str, rules: dict[str, str]) -> DataFrame:
        """df written to path and read back, its row rules counted on the way."""
        seen = Observation()
        counts = [F.count(F.lit(1)).alias("_rows"), *(F.count_if(~F.coalesce(F.expr(r), F.lit(False))).alias(n) for n, r in rules.items())]
        df.observe(seen, *counts).write.parquet(path)
        self.scans += 1
        self.found += [(n, seen.get["_rows"], seen.get[n]) for n in rules]
        return self.spark.read.schema(df.schema).parquet(path)

    def keyed(self, df: DataFrame, keys: list[str], aggregates: dict[str, Column], rules: dict[str, str]) -> None:
        """Rules over the aggregates of each key: one shuffle for all of them."""
        groups = df.groupBy(*keys).agg(*(c.alias(n) for n, c in aggregates.items()))
        row = groups.agg(F.count("*").alias("_rows"), *(F.count_if(~F.coalesce(F.expr(r), F.lit(False))).alias(n) for n, r in rules.items())).first()
        self.scans += 1
        self.found += [(n, row["_rows"], row[n]) for n in rules]

    def table(self) -> DataFrame:
        """check, looked_at, violations, passed."""
        return self.spark.createDataFrame([(n, int(k), int(v), not v) for n, k, v in self.found], "check string, looked_at long, violations long, passed boolean")


def digest(df: DataFrame, columns: list[str]) -> tuple[int, int]:
    """Rows, and the sum of the first 32 bits of the MD5 of each row's text: independent of order and partitions, and rows that
    repeat count each.
    """
    text = F.concat_ws("|", *(F.coalesce(F.col(c).cast("string"), F.lit("~")) for c in columns))
    row = df.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.conv(F.substring(F.md5(text), 1, HASH_DIGITS), 16, 10).cast("long")), F.lit(0)).alias("s")).first()
    return row["n"], row["s"]


def chain(links: list[dict], spark: SparkSession) -> DataFrame:
    """name, rows, digest, source, stated, link_ok: whether the digest that a record states of its source is the source's own.

    ``links`` are one record an artifact: name, rows, digest, source (its name or None), stated (digest of the source).
    """
    df = spark.createDataFrame([(x["name"], x["rows"], x["digest"], x["source"], x["stated"]) for x in links], "name string, rows long, digest long, source string, stated long")
    own = df.select(F.col("name").alias("source"), F.col("digest").alias("_own"))
    joined = df.join(own, "source", "left")
    return joined.select("name", "rows", "digest", "source", "stated", F.when(F.col("source").isNull(), F.lit(True)).otherwise(F.coalesce(F.col("stated") == F.col("_own"), F.lit(False))).alias("link_ok"))
