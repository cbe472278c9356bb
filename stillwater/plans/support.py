"""Queries of the supporting steps: invalid videos, decisions as text, populations, frame plans, bags."""

from __future__ import annotations

from pyspark.sql import functions as F

from stillwater.operators import metrics, resampling
from stillwater.plans import fixtures as X
from stillwater.plans.fixtures import query, r9
from stillwater.plans.flagships import _ABS_VALUES, _PAIR_VALUES, _RGROUP, REPLICATES, _absolute_sql, _calibrated, _paired_sql, _resampled_sql

_VIDEO = "detector, dataset, role, video, condition"


@query("sup_01", f"WITH {X.VIDEOS} SELECT {_VIDEO}, 'invalid_condition' AS inference_status, 'failed frame' AS failure_reason FROM videos WHERE video_score IS NULL")
def sup_01(spark, sf):
    """Videos without a valid score keep their keys and the reason."""
    scores = X.video_scores(spark, sf).where("video_score is null")
    return scores.select(*_VIDEO.split(", "), "inference_status", "failure_reason")


@query("sup_02", f"WITH {X.DECISIONS} SELECT {_VIDEO}, coalesce(CAST(decision AS VARCHAR), '') AS decision FROM decisions")
def sup_02(spark, sf):
    """Decisions as text, empty where there is no score."""
    return X.decisions(spark, sf).select(*_VIDEO.split(", "), F.coalesce(F.col("decision").cast("string"), F.lit("")).alias("decision"))


@query("sup_41", f"WITH {X.DECISIONS} SELECT {_VIDEO}, round(video_score, 9) AS video_score, coalesce(CASE WHEN condition = 'CLN' THEN decision END, CAST(video_score >= 0.5 AS INTEGER)) AS decision FROM decisions WHERE video_score IS NOT NULL")
def sup_41(spark, sf):
    """Rows with label and score; a decision is made anew only where none is stored."""
    rows = X.decisions(spark, sf).where("video_score is not null and study_label is not null")
    stored = F.when(F.col("condition") == "CLN", F.col("decision"))
    return r9(rows.select(*_VIDEO.split(", "), "video_score", F.coalesce(stored, (F.col("video_score") >= 0.5).cast("int")).alias("decision")))


@query("sup_16", f"WITH {X.CUT} SELECT count(*) AS n, count(*) - count(DISTINCT detector) AS repeated, count(*) FILTER (max_allowed <> (5 * n_real) // 100) AS wrong_budget, count(*) FILTER (false_positives > max_allowed) AS over_budget FROM cut")
def sup_16(spark, sf):
    """What a table of frozen thresholds must not have: repeated detectors, another budget, too many false positives."""
    cut = X.frozen(X.video_scores(spark, sf))
    return cut.agg(
        F.count("*").alias("n"),
        (F.count("*") - F.count_distinct("detector")).alias("repeated"),
        F.count_if(F.expr("max_allowed_false_positives <> (5 * n_real) div 100")).alias("wrong_budget"),
        F.count_if(F.expr("false_positives > max_allowed_false_positives")).alias("over_budget"),
    )


@query("sup_25", f"WITH {X.PLAN} SELECT video, CAST(unnest(range(0, n)) AS INTEGER) AS temporal_position FROM plan")
def sup_25(spark, sf):
    """One row a planned frame."""
    return X.plan(spark, sf).select("video", F.explode("positions").alias("temporal_position"))


@query("sup_14", f"WITH {X.DECISIONS} SELECT detector, condition, count(*) FILTER (study_label = 0) AS n_real, count(*) FILTER (study_label = 1) AS n_manipulated, round(avg(video_score) FILTER (study_label = 0), 9) AS real_score, round(avg(video_score) FILTER (study_label = 1), 9) AS manipulated_score FROM decisions WHERE video_score IS NOT NULL GROUP BY ALL")
def sup_14(spark, sf):
    """Both labels' rows side by side in one pass."""
    real, fake = F.col("study_label") == 0, F.col("study_label") == 1
    rows = X.decisions(spark, sf).where("video_score is not null")
    return r9(rows.groupBy("detector", "condition").agg(F.count_if(real).alias("n_real"), F.count_if(fake).alias("n_manipulated"), F.avg(F.when(real, F.col("video_score"))).alias("real_score"), F.avg(F.when(fake, F.col("video_score"))).alias("manipulated_score")))


@query("bst_06", f"WITH {X.CUT}, {_resampled_sql('calib', 'detector', 'primary_clean_validation', 'cs')} SELECT detector, stratum, video, replicate, w FROM cs")
def bst_06(spark, sf):
    """The bag of each replicate: units with the number of times that they were drawn."""
    numbered = resampling.units(X.calibration(X.video_scores(spark, sf)).withColumn("stratum", resampling.stratum()), ["detector"])
    drawn = resampling.draws(numbered, ["detector"], REPLICATES, 1024, "primary_clean_validation")
    return numbered.join(drawn.select("detector", "stratum", "replicate", "k", "w"), ["detector", "stratum", "k"]).select("detector", "stratum", "video", F.col("replicate").cast("long").alias("replicate"), "w")


_SECOND = "WHERE dataset = 'second'"
_ZERO = "CASE WHEN abs({0}) < 5e-10 THEN 0.0 ELSE round({0}, 9) END"  # no difference is 0, never -0


@query("bst_13", f"WITH {X.PAIRS}, {_absolute_sql()}, {_paired_sql()} SELECT 'absolute' AS kind, {_RGROUP}, round(auc, 9) AS auc, round(fpr, 9) AS fpr, round(fnr, 9) AS fnr, round(hter, 9) AS hter FROM ({_ABS_VALUES}) {_SECOND} UNION ALL SELECT 'paired' AS kind, {_RGROUP}, {_ZERO.format('delta_auc')}, {_ZERO.format('delta_fpr')}, {_ZERO.format('delta_fnr')}, {_ZERO.format('delta_hter')} FROM ({_PAIR_VALUES}) {_SECOND}")
def bst_13(spark, sf):
    """The second dataset has one pooled group: its metrics and its paired deltas in every replicate."""
    decided, calib = _calibrated(spark, sf)
    second = decided.where("dataset = 'second'")
    names = ["auc", "fpr", "fnr", "hter"]
    parts = {"absolute": resampling.absolute(second, calib, REPLICATES), "paired": resampling.paired(second, calib, REPLICATES)}
    columns = {"absolute": names, "paired": [f"delta_{m}" for m in names]}
    out = [p.select(F.lit(k).alias("kind"), *metrics.GROUP_KEYS, F.col("replicate").cast("long").alias("replicate"), *(F.col(c).alias(m) for m, c in zip(names, columns[k], strict=True))) for k, p in parts.items()]
    both = r9(out[0].unionByName(out[1]))
    return both.withColumns({m: F.when(F.abs(m) < 5e-10, 0.0).otherwise(F.col(m)) for m in names})


for _alias, _target in (("sup_06", "f3_absolute_metrics"), ("sup_07", "bst_07")):
    query(_alias, X.ORACLE[_target])(X.QUERIES[_target])
