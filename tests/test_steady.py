"""Means that tie must come out as the same double, whatever the order of the rows."""

import datetime

from pyspark.sql import functions as F

from stillwater.functions import scalars as S
from stillwater.operators import thresholds, videos
from stillwater.plans import relational

UP, DOWN = [0.1, 0.2, 0.3], [0.3, 0.2, 0.1]  # summed in these orders, two different doubles


def test_steady_mean(spark):
    rows = spark.createDataFrame([(1, 0.3), (1, None), (1, 0.1), (2, None)], "k int, x double").coalesce(1)
    assert {r["k"]: r["m"] for r in rows.groupBy("k").agg(S.steady_mean("x").alias("m")).collect()} == {1: (0.1 + 0.3) / 2, 2: None}


def test_equal_videos_are_one_candidate(spark):
    frames = [(v, p, x) for v, own in ((1, UP), (2, DOWN)) for p, x in enumerate(own)]
    rows = spark.createDataFrame(frames, "video int, temporal_position int, score double").withColumn("inference_status", F.lit("ok")).coalesce(1)
    plan = spark.createDataFrame([(1, [0, 1, 2]), (2, [0, 1, 2])], "video int, positions array<int>")
    for scores in (videos.strict_scores(rows, plan, ["video"], ["video"]).withColumnRenamed("video_score", "score"), videos.mean_scores(rows.withColumn("label", F.lit(0)), ["video"], 3)):
        cut = thresholds.low_fpr(scores.withColumn("detector", F.lit("d")), ["detector"]).first()
        assert (cut["n_real"], cut["candidate_count"]) == (2, 2)


def test_equal_videos_tie_in_case_selection(spark, tmp_path):
    kinds = ("view", "click", "error", "purchase", "signup")
    start, events = datetime.datetime(2024, 1, 1), []
    for user, own in ((0, UP), (1500, DOWN)):
        for kind in kinds:
            for x in own if kind == "view" else [0.5]:
                events.append((len(events), start + datetime.timedelta(seconds=len(events)), user, kind, 500 * x, "{}"))
    spark.createDataFrame(events, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    assert len({r["cln"] for r in relational.wide(spark, str(tmp_path)).collect()}) == 1
    assert [r["video"] for r in relational.win_07(spark, str(tmp_path)).where("case_class = 'A'").orderBy("place").collect()] == [1500, 0]
