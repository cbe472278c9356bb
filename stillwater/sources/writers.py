"""Writers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def csv(rows: DataFrame, path: str, columns: list[str]) -> None:
    """The named columns in order, missing values empty."""
    rows.select(*columns).write.mode("overwrite").option("header", True).option("nullValue", "").option("emptyValue", "").option("escape", '"').csv(path)


def append(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").parquet(path)


def union_of_columns(parts: list[DataFrame]) -> DataFrame:
    """Rows of all parts under all their columns, in the order they first appear."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def json_lines(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def resume(rows: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """What the log of done keys lacks."""
    return rows.join(done.select(*keys).distinct(), keys, "left_anti")


def as_document(rows: DataFrame, keys: list[str]) -> DataFrame:
    """One JSON text a key with its rows in order: for results that are small by nature."""
    others = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.to_json(F.sort_array(F.collect_list(F.struct(*others)))).alias("document"))
