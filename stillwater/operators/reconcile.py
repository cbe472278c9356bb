"""Several tables of records against each other by key, in one shuffle.

Each table adds one bit to a key's presence; fields are compared null-safely between the tables that have the key.  A key is
aggregated before the shuffle, so keys that a table repeats cost little and are reported.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def reconciled(tables: dict[str, DataFrame], keys: list[str], fields: list[str]) -> DataFrame:
    """keys, missing (tables without the key), repeated (tables with several rows of it) and differing (fields whose values
    aren't one and the same), each a sorted array: a row for each key with a fault.

    ``fields`` are texts or are compared as texts; a table that lacks a field leaves it out of the comparison.  Keys that are
    null are keys like others.
    """
    sides = []
    for place, (_, df) in enumerate(tables.items()):
        held = [F.struct(F.lit(True).alias("known"), F.col(f).cast("string").alias("value")) if f in df.columns else F.lit(None).cast("struct<known:boolean,value:string>") for f in fields]
        sides.append(df.select(*keys, F.lit(1 << place).alias("bit"), *(h.alias(f) for h, f in zip(held, fields, strict=True))))
    rows = reduce(DataFrame.unionByName, sides)
    count = [F.count_if(F.col("bit") == (1 << k)).alias(f"_n{k}") for k in range(len(tables))]
    # of equal values least and greatest agree; a null orders before all texts, so it differs from each of them
    ends = [c for f in fields for c in (F.min(f).alias(f"_a_{f}"), F.max(f).alias(f"_b_{f}"))]
    found = rows.groupBy(*keys).agg(*count, *ends)

    def told(cells: list) -> F.Column:
        return F.sort_array(F.filter(F.array(*cells), lambda x: x.isNotNull()))

    names = list(tables)
    missing = told([F.when(F.col(f"_n{k}") == 0, F.lit(n)) for k, n in enumerate(names)])
    repeated = told([F.when(F.col(f"_n{k}") > 1, F.lit(n)) for k, n in enumerate(names)])
    differing = told([F.when(~F.col(f"_a_{f}").eqNullSafe(F.col(f"_b_{f}")), F.lit(f)) for f in fields]) if fields else F.array().cast("array<string>")
    out = found.select(*keys, missing.alias("missing"), repeated.alias("repeated"), differing.alias("differing"))
    return out.where((F.size("missing") > 0) | (F.size("repeated") > 0) | (F.size("differing") > 0))
