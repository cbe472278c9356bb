"""Stratified cluster bootstrap.

A replicate draws, for each stratum, as many units as it has, with replacement.  Only how often a unit was drawn is
kept, as a weight.  Contexts that a task can hold go by ``replicates``, as matrices of weights; of larger ones a replicate is
one more grouping key and a draw a row.  Both give the same values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stillwater.functions import scalars as S
from stillwater.operators import metrics, replicates as blocks, thresholds


def stratum(label: str = "study_label", manipulation: str = "manipulation") -> Column:
    """real, the method, or manipulated where no method is named."""
    return F.when(F.col(label) == 0, "real").when(F.coalesce(manipulation, F.lit("")) != "", F.col(manipulation)).otherwise("manipulated")


def cluster(dataset: str = "dataset", source: str = "source", base: str = "video") -> Column:
    """The unit of a draw: the source that several videos share in the first dataset, the video itself in the second."""
    return F.when(F.col(dataset) == "first", F.concat_ws("::", F.lit("source"), F.col(source).cast("string"))).otherwise(F.concat_ws("::", F.lit("base"), F.col(base).cast("string")))


def units(rows: DataFrame, context: list[str], unit: str = "video") -> DataFrame:
    """The distinct units of each stratum, numbered from 0 in their order as text, with the stratum's size n."""
    distinct = rows.select(*context, "stratum", unit).distinct()
    inside = Window.partitionBy(*context, "stratum")
    return distinct.withColumns({"k": F.row_number().over(inside.orderBy(F.col(unit).cast("string"))) - 1, "n": F.count("*").over(inside)})


def draws(numbered: DataFrame, context: list[str], replicates: int, seed: int, stream: str) -> DataFrame:
    """replicate, stratum, k, w: how often each unit was drawn; a unit that wasn't has no row.

    Strata of up to ``MOST_ROWS`` units are drawn in blocks; of larger ones a draw is a row, in the task of its replicate.
    """
    sizes = numbered.groupBy(*context, "stratum").agg(F.max("n").alias("n"))
    keys, most = [*context, "stratum", "replicate"], F.lit(blocks.MOST_ROWS)
    each = sizes.where(F.col("n") > most).select("*", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))).alias("replicate"))
    each = blocks.dealt(each, keys).select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("i"))
    k = S.draw("n", F.lit(seed), F.lit(stream), "replicate", "stratum", "i").cast("int")
    large = each.withColumn("k", k).groupBy(*keys, "k").agg(F.count("*").alias("w"))
    return blocks.unit_counts(sizes.where(F.col("n") <= most), context, replicates, seed, stream).unionByName(large)


def resampled(rows: DataFrame, context: list[str], replicates: int, seed: int, stream: str, unit: str = "video") -> DataFrame:
    """Rows with replicate and weight w."""
    numbered = units(rows, context, unit)
    drawn = draws(numbered, context, replicates, seed, stream).join(numbered, [*context, "stratum", "k"]).select(*context, "stratum", unit, "replicate", "w")
    return rows.join(drawn, [*context, "stratum", unit])


def _sized(rows: DataFrame, context: list[str]) -> tuple[DataFrame, DataFrame | None]:
    """Rows of contexts that a task can hold, and the others if there are any."""
    large = rows.groupBy(*context).agg(F.count("*").alias("n")).where(F.col("n") > blocks.MOST_ROWS).drop("n")
    if large.isEmpty():
        return rows, None
    return rows.join(large, context, "left_anti"), rows.join(large, context, "left_semi")


def replicate_thresholds(calibration: DataFrame, replicates: int, seed: int, unit: str = "video", rule: str = "portable") -> DataFrame:
    """detector, replicate, threshold_value: the operating point in each replicate of the clean real validation videos."""
    rows = calibration.withColumns({"stratum": F.lit("real"), "unit": F.col(unit)})
    small, large = _sized(rows, ["detector"])
    out = blocks.operating_points(small, ["detector"], {"threshold_value": "video_score"}, replicates, seed, "primary_clean_validation", rule)
    return out if large is None else out.unionByName(thresholds_by_draws(large, replicates, seed))


def thresholds_by_draws(rows: DataFrame, replicates: int, seed: int) -> DataFrame:
    drawn = resampled(rows, ["detector"], replicates, seed, "primary_clean_validation", "unit")
    found = thresholds.low_fpr(drawn.withColumn("score", F.col("video_score")), ["detector", "replicate"], weight="w")
    return found.select("detector", F.col("replicate").cast("int").alias("replicate"), "threshold_value")


CONTEXT = ["detector", "dataset", "role", "condition"]
NAMES = ("auc", "fpr", "fnr", "hter")


def _evaluated(rows: DataFrame, scores: dict[str, str], cut: DataFrame, replicates: int, seed: int, stream: str, unit: str, rule: str) -> DataFrame:
    rows = rows.withColumns({"stratum": stratum(), "unit": F.col(unit), "groups": metrics.groups_of()}).where(metrics.evaluated())
    small, large = _sized(rows, CONTEXT)
    out = blocks.group_metrics(small, CONTEXT, scores, cut, replicates, seed, stream, rule)
    return out if large is None else out.unionByName(metrics_by_draws(large, scores, cut, replicates, seed, stream))


def metrics_by_draws(rows: DataFrame, scores: dict[str, str], cut: DataFrame, replicates: int, seed: int, stream: str) -> DataFrame:
    """The same as ``replicates.group_metrics`` by portable draws, with a row a draw: for contexts that no task can hold."""
    drawn = resampled(rows, CONTEXT, replicates, seed, stream, "unit").withColumn("replicate", F.col("replicate").cast("int"))
    wide = drawn.drop("decision", "threshold_value").join(cut, ["detector", "replicate"]).withColumn("metric_group", F.explode("groups"))
    keys, out = [*metrics.GROUP_KEYS, "replicate"], None
    for prefix, c in scores.items():
        own = metrics.bundle(wide.withColumn("decision", (F.col(c) >= F.col("threshold_value")).cast("int")), keys, score=c, weight="w")
        own = own.select(*keys, *(F.col(m).alias(f"{prefix}{m}") for m in NAMES))
        out = own if out is None else out.join(own, keys)
    return out


def absolute(decisions: DataFrame, calibration: DataFrame, replicates: int, seed: int = 1024, unit: str = "video", rule: str = "portable") -> DataFrame:
    """Metrics of every group in every replicate, at the threshold of that replicate.

    A method's group and the pooled one share the draws of their context.
    """
    cut = replicate_thresholds(calibration, replicates, seed, unit, rule)
    return _evaluated(decisions.where(F.col("video_score").isNotNull()), {"": "video_score"}, cut, replicates, seed, "absolute", unit, rule)


def paired(decisions: DataFrame, calibration: DataFrame, replicates: int, seed: int = 1024, unit: str = "video", rule: str = "portable") -> DataFrame:
    """Deltas of every group in every replicate; one draw serves the clean and the degraded side."""
    cut = replicate_thresholds(calibration, replicates, seed, unit, rule)
    both = _evaluated(metrics.pairs(decisions), {"": "video_score", "clean_": "clean_score"}, cut, replicates, seed, "paired", unit, rule)
    return both.select(*metrics.GROUP_KEYS, "replicate", *((F.col(m) - F.col(f"clean_{m}")).alias(f"delta_{m}") for m in NAMES))


def displaced(rows: DataFrame, replicates: int, seed: int = 1024, unit: str = "video", rule: str = "portable") -> DataFrame:
    """detector, condition, replicate, displacement: a condition's own operating point less that of the clean scores, over one
    draw of the real validation videos that have both (columns video_score, clean_score).
    """
    keys = ["detector", "condition"]
    rows = rows.withColumns({"stratum": F.lit("real"), "unit": F.col(unit)})
    small, large = _sized(rows, keys)
    out = blocks.operating_points(small, keys, {"own": "video_score", "clean": "clean_score"}, replicates, seed, "diagnostic", rule)
    if large is not None:
        drawn = resampled(large, keys, replicates, seed, "diagnostic", "unit")
        own, clean = (thresholds.low_fpr(drawn.withColumn("score", F.col(c)), [*keys, "replicate"], weight="w").select(*keys, "replicate", F.col("threshold_value").alias(n)) for n, c in (("own", "video_score"), ("clean", "clean_score")))
        out = out.unionByName(own.join(clean, [*keys, "replicate"]))
    return out.select(*keys, "replicate", (F.col("own") - F.col("clean")).alias("displacement"))


def intervals(values: DataFrame, keys: list[str], names: list[str], low: float = 0.025, high: float = 0.975) -> DataFrame:
    """Exact percentile interval of each metric, interpolated at p (n - 1)."""
    out = values.groupBy(*keys).agg(F.count("*").alias("n_replicates"), *(F.expr(f"percentile({m}, array({low}D, {high}D))").alias(f"_{m}") for m in names))
    return out.select(*keys, "n_replicates", *(F.col(f"_{m}")[k].alias(f"{m}_{side}") for m in names for k, side in enumerate(("lower", "upper"))))
