"""Small cases with known results."""

import pytest
from pyspark.sql import functions as F

from stillwater.operators import metrics, resampling, selection, thresholds


def scored(spark, real, fake):
    return spark.createDataFrame([("d", 0, float(s)) for s in real] + [("d", 1, float(s)) for s in fake], "detector string, label int, score double")


@pytest.mark.parametrize(
    ("real", "fake", "want"),
    [([0.1, 0.2], [0.8, 0.9], 1.0), ([0.8, 0.9], [0.1, 0.2], 0.0), ([0.5, 0.5], [0.5, 0.5], 0.5), ([0.1, 0.5], [0.5, 0.9], 0.875)],
)
def test_auc(spark, real, fake, want):
    row = metrics.auc(scored(spark, real, fake), ["detector"]).first()
    assert row["auc"] == pytest.approx(want, abs=1e-15)
    assert (row["n_real"], row["n_manipulated"]) == (len(real), len(fake))


def test_auc_of_one_class_is_null(spark):
    assert metrics.auc(scored(spark, [0.1, 0.2], []), ["detector"]).first()["auc"] is None


def test_rates(spark):
    rows = spark.createDataFrame([("d", int(a), int(b)) for a, b in zip("000111", "010100", strict=True)], "detector string, label int, decision int")
    row = metrics.rates(rows, ["detector"]).first()
    assert (row["tn"], row["fp"], row["tp"], row["fn"]) == (2, 1, 1, 2)
    assert (row["fpr"], row["fnr"], row["hter"]) == pytest.approx((1 / 3, 2 / 3, 0.5), abs=1e-15)


def test_rates_without_manipulated_rows(spark):
    row = metrics.rates(spark.createDataFrame([("d", 0, 1)], "detector string, label int, decision int"), ["detector"]).first()
    assert (row["fpr"], row["fnr"], row["hter"]) == (1.0, None, None)


def test_percentile_interval(spark):
    row = resampling.intervals(spark.range(5).select(F.lit("g").alias("g"), F.col("id").cast("double").alias("m")), ["g"], ["m"]).first()
    assert (row["m_lower"], row["m_upper"]) == pytest.approx((0.1, 3.9))


def brute_threshold(scores, num, den):
    """The lowest candidate with so few scores at or above it."""
    budget = num * len(scores) // den
    return min((t for t in set(scores) if sum(s >= t for s in scores) <= budget), default=None)


@pytest.mark.parametrize("scores", [[0.1 * k for k in range(20)], [0.5] * 40, [0.1, 0.9], [0.2] * 30 + [0.7, 0.8, 0.8], [0.3] * 19 + [0.9]])
def test_operating_point(spark, scores):
    row = thresholds.low_fpr(scored(spark, scores, []), ["detector"]).first()
    want = brute_threshold(scores, 5, 100)
    if want is None:
        assert row["threshold_value"] > max(scores) and row["threshold_value"] == pytest.approx(max(scores), abs=1e-12)
    else:
        assert row["threshold_value"] == want
    assert row["false_positives"] == sum(s >= row["threshold_value"] for s in scores) <= row["max_allowed_false_positives"]


def decided(spark, flip):
    """Videos that the detector tells apart when clean, and the wrong way round when degraded."""
    rows = [("d", "second", "external_evaluation", v, c, v % 2, "", float(v % 2 == (c == "CLN") if flip else v % 2), 0.5) for v in range(8) for c in ("CLN", "BLR")]
    df = spark.createDataFrame(rows, "detector string, dataset string, role string, video long, condition string, study_label int, manipulation string, video_score double, threshold_value double")
    return df.withColumn("decision", (F.col("video_score") >= F.col("threshold_value")).cast("int"))


def test_paired_flip(spark):
    row = metrics.paired_deltas(decided(spark, True)).first()
    assert (row["delta_auc"], row["delta_fpr"], row["delta_fnr"], row["delta_hter"]) == (-1, 1, 1, 1)


def test_pairs_need_both_sides(spark):
    rows = decided(spark, False).withColumn("video_score", F.when((F.col("video") == 3) & (F.col("condition") == "BLR"), None).otherwise(F.col("video_score")))
    row = metrics.paired_deltas(rows).first()
    assert (row["n_real"], row["n_manipulated"]) == (4, 3)
    assert row["delta_auc"] == 0


def test_latest_and_first(spark):
    rows = spark.createDataFrame([("a", 1, "x"), ("a", 3, "z"), ("a", 2, "y"), ("b", 1, "w")], "k string, n int, v string")
    assert {(r["k"], r["v"]) for r in selection.latest(rows, ["k"], "n").collect()} == {("a", "z"), ("b", "w")}
    assert {(r["k"], r["v"]) for r in selection.first_by(rows, ["k"], [F.col("n").asc()]).collect()} == {("a", "x"), ("b", "w")}


def test_running_best_is_strict(spark):
    rows = spark.createDataFrame([("a", k, v) for k, v in enumerate([0.5, 0.5, 0.7, 0.6])], "k string, n int, v double")
    got = selection.running_best(rows, ["k"], "n", "v").orderBy("n").collect()
    assert [r["improved"] for r in got] == [True, False, True, False]


def test_empty_input(spark):
    none = scored(spark, [0.1], [0.2]).limit(0)
    assert metrics.auc(none, ["detector"]).count() == 0
    assert thresholds.low_fpr(none, ["detector"]).count() == 0
    assert thresholds.best_f1(none, ["detector"]).count() == 0
