"""Operating points.  A decision is 1 where score >= threshold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stillwater.functions import scalars as S


def budget(n, num: int = 5, den: int = 100) -> Column:
    """The largest number of false positives: floor of n num / den, in integers."""
    return F.expr(f"({num} * {n}) div {den}") if isinstance(n, str) else F.floor(n * num / den)


def low_fpr(scores: DataFrame, keys: list[str], num: int = 5, den: int = 100, weight: str | None = None) -> DataFrame:
    """The lowest threshold whose false positives among ``score`` (real videos) keep to the budget.

    Candidates are the scores and the next double above the largest.  One sort a key instead of candidates x scores.
    """
    n = F.sum(weight) if weight else F.count("*")
    hist = scores.groupBy(*keys, "score").agg(n.cast("long").alias("n"))
    down = Window.partitionBy(*keys).orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*keys)
    hist = hist.withColumns({"at_least": F.sum("n").over(down), "n_real": F.sum("n").over(whole)})
    within = F.col("at_least") <= F.expr(f"({num} * n_real) div {den}")
    out = hist.groupBy(*keys).agg(F.min(F.when(within, F.col("score"))).alias("own"), F.max("score").alias("top"), F.max("n_real").alias("n_real"), F.max(F.when(within, F.col("at_least"))).alias("fp"), F.count("*").alias("n_scores"))
    return out.select(*keys, F.coalesce("own", S.next_up("top")).alias("threshold_value"), "n_real", F.coalesce("fp", F.lit(0).cast("long")).alias("false_positives"), F.expr(f"({num} * n_real) div {den}").alias("max_allowed_false_positives"), (F.coalesce("fp", F.lit(0)) / F.col("n_real")).alias("realized_fpr"), (F.col("n_scores") + 1).alias("candidate_count"))


def low_fpr_legacy(scores: DataFrame, keys: list[str], target: float) -> DataFrame:
    """The older rule: top candidate max + max(1e-12, |max| 1e-12), and FPR <= target in floating point."""
    hist = scores.groupBy(*keys, "score").agg(F.count("*").alias("n"))
    down = Window.partitionBy(*keys).orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, 0)
    hist = hist.withColumns({"at_least": F.sum("n").over(down), "n_real": F.sum("n").over(Window.partitionBy(*keys))})
    within = F.col("at_least") / F.col("n_real") <= F.lit(target)
    out = hist.groupBy(*keys).agg(F.min(F.when(within, F.col("score"))).alias("own"), F.max("score").alias("top"), F.max("n_real").alias("n_real"))
    above = F.col("top") + F.greatest(F.lit(1e-12), F.abs("top") * 1e-12)
    return out.select(*keys, F.coalesce("own", above).alias("threshold_value"), "n_real")


def curve(rows: DataFrame, keys: list[str]) -> DataFrame:
    """For each distinct score as threshold: true and false positives, positives and negatives (columns score, label)."""
    hist = rows.groupBy(*keys, "score").agg(F.sum("label").cast("long").alias("p"), F.sum(1 - F.col("label")).cast("long").alias("q"))
    down = Window.partitionBy(*keys).orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*keys)
    return hist.withColumns({"tp": F.sum("p").over(down), "fp": F.sum("q").over(down), "P": F.sum("p").over(whole), "N": F.sum("q").over(whole)})


def _with_top(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The curve with one candidate above all scores, where nothing is positive."""
    points = curve(rows, keys)
    top = points.groupBy(*keys).agg(F.max("score").alias("m"), F.max("P").alias("P"), F.max("N").alias("N"))
    top = top.select(*keys, (F.col("m") + F.greatest(F.lit(1e-12), F.abs("m") * 1e-12)).alias("score"), F.lit(0).cast("long").alias("tp"), F.lit(0).cast("long").alias("fp"), "P", "N")
    return points.select(*keys, "score", "tp", "fp", "P", "N").unionByName(top)


def eer_like(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The candidate with the smallest |FPR - FNR|, the lowest on a tie."""
    gap = F.abs(F.col("fp") / F.col("N") - (F.col("P") - F.col("tp")) / F.col("P"))
    best = Window.partitionBy(*keys).orderBy(gap, "score")
    return _with_top(rows, keys).withColumn("r", F.row_number().over(best)).where("r = 1").select(*keys, F.col("score").alias("threshold_value"), (F.col("fp") / F.col("N")).alias("fpr"), ((F.col("P") - F.col("tp")) / F.col("P")).alias("fnr"))


def best_f1(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The candidate with the largest F1, the lowest on a tie; empty denominators give 0."""
    precision, recall = S.ratio_or_zero("tp", F.col("tp") + F.col("fp")), S.ratio_or_zero("tp", "P")
    points = _with_top(rows, keys).withColumns({"precision": precision, "recall": recall})
    f1 = S.ratio_or_zero(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))
    points = points.withColumn("f1", f1)
    best = Window.partitionBy(*keys).orderBy(F.desc("f1"), "score")
    return points.withColumn("r", F.row_number().over(best)).where("r = 1").select(*keys, F.col("score").alias("threshold_value"), "f1", "precision", "recall")


def decide(rows: DataFrame, thresholds: DataFrame, keys: list[str], score: str = "video_score") -> DataFrame:
    """Rows with threshold_value and decision; null where there is no score.  Thresholds are one row a key of ``keys``.

    No hint: the optimizer broadcasts them while they are small.
    """
    joined = rows.join(thresholds.select(*keys, "threshold_value"), keys, "left")
    return joined.withColumns({"decision": (F.col(score) >= F.col("threshold_value")).cast("int"), "decision_status": F.when(F.col(score).isNull(), "not_scored").otherwise("decided")})


def false_positives(real: DataFrame, keys: list[str], score: str, threshold: str) -> DataFrame:
    """keys, fp, n_real, fpr: rows of the real class at or above their threshold, and their share."""
    fp = F.count_if(F.col(score) >= F.col(threshold))
    return real.groupBy(*keys).agg(fp.alias("fp"), F.count("*").alias("n_real"), (fp / F.count("*")).alias("fpr"))
