"""From frame scores to one score a video."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stillwater.functions import scalars as S


def mean_scores(frames: DataFrame, keys: list[str], expected: int) -> DataFrame:
    """Unweighted mean of the scores that exist, with coverage; labels are averaged and rounded half to even.

    face_found repeats score_available: a video counts as seen when a frame of it was scored.
    """
    scored = F.count("score")
    out = frames.groupBy(*keys).agg(S.steady_mean("score").alias("score"), F.bround(F.avg("label"), 0).cast("int").alias("label"), scored.cast("long").alias("n_frames_scored"))
    available = F.col("n_frames_scored") > 0
    partial = available & (F.col("n_frames_scored") < expected)
    reason = F.when(~available, "no_scored_frames_for_video").when(partial, "partial_frame_coverage").otherwise("")
    return out.withColumns({
        "n_frames_expected": F.lit(expected),
        "n_frames_missing": F.greatest(F.lit(expected) - F.col("n_frames_scored"), F.lit(0)).cast("long"),
        "frame_score_coverage": F.col("n_frames_scored") / F.lit(float(expected)),
        "partial_score": partial,
        "score_available": available,
        "face_found": available,
        "failure_stage": F.when(reason == "", "").otherwise("video_aggregation"),
        "failure_reason": reason,
    })


def strict_scores(frames: DataFrame, plan: DataFrame, keys: list[str], video: list[str], order: str | None = None) -> DataFrame:
    """One record a video of ``keys``; its score is null unless the frames are exactly the planned ones and all valid.

    ``plan`` has ``video`` and positions (an array).  Failures are named in this order: no planned position, repeated
    position, missing or extra positions, a frame that failed, a score that isn't a number in [0, 1].  Scores are summed along
    ``order``, without it from the least to the largest.
    """
    ok = F.col("inference_status") == "ok"
    fine = F.col("score").isNotNull() & ~F.isnan("score") & F.col("score").between(0, 1)
    seen = frames.groupBy(*keys).agg(
        F.sort_array(F.collect_list("temporal_position")).alias("received"),
        F.count_if(ok).alias("n_ok"),
        F.count_if(ok & fine).alias("n_fine"),
        S.steady_mean("score", order).alias("mean"),
    )
    joined = seen.join(plan.select(*video, "positions"), video, "left")
    positions = F.coalesce("positions", F.array().cast("array<int>"))
    same = F.col("received") == positions
    stage = F.when(F.size(positions) == 0, "clean_geometry").when(~same | (F.col("n_ok") < F.size("received")) | (F.col("n_fine") < F.col("n_ok")), "detector_inference")
    reason = (
        F.when(F.size(positions) == 0, "no planned position")
        .when(F.size("received") != F.size(F.array_distinct("received")), "repeated position")
        .when(~same, "missing or extra positions")
        .when(F.col("n_ok") < F.size("received"), "failed frame")
        .when(F.col("n_fine") < F.col("n_ok"), "score out of range")
    )
    valid = reason.isNull()
    return joined.select(
        *keys,
        F.size(positions).cast("long").alias("clean_valid_frame_count"),
        F.col("n_ok").alias("successful_frame_count"),
        F.when(valid, F.col("mean")).alias("video_score"),
        F.when(valid, "ok").when(F.size(positions) == 0, "insufficient_valid_input").otherwise("invalid_condition").alias("inference_status"),
        stage.alias("failure_stage"),
        reason.alias("failure_reason"),
    )


def scores_by_parent(frames: DataFrame, path: str = "path") -> DataFrame:
    """Mean by the whole parent path; labels must agree within a video (n_labels tells)."""
    return frames.groupBy(S.parent_path(path).alias("video")).agg(F.avg("score").alias("score"), F.max("label").alias("label"), F.countDistinct("label").alias("n_labels"), F.count("*").alias("n"))


def scores_by_folder_name(frames: DataFrame, path: str = "path") -> DataFrame:
    """Mean by the last folder's name alone: videos of one name merge, and the mean label is cut to an integer."""
    return frames.groupBy(S.parent_name(path).alias("video")).agg(F.avg("score").alias("score"), F.floor(F.avg("label")).cast("int").alias("label"), F.count("*").alias("n"))


def with_unscored(videos: DataFrame, expected: DataFrame, key: list[str]) -> DataFrame:
    """Videos and, with null scores, those that were expected but have none."""
    missing = expected.join(videos.select(*key).distinct(), key, "left_anti")
    return videos.unionByName(missing, allowMissingColumns=True)


def coverage(videos: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """How many videos there are, were scored, seen, partly scored, and the rates."""
    out = videos.groupBy(*(keys or [])).agg(
        F.count("*").alias("n_total_videos"),
        F.count_if("score_available").alias("n_scored_videos"),
        F.count_if(~F.col("score_available")).alias("n_no_score_videos"),
        F.count_if("face_found").alias("n_face_found_videos"),
        F.count_if("partial_score").alias("n_partial_videos"),
    )
    return out.withColumns({"score_available_rate": S.ratio("n_scored_videos", "n_total_videos"), "face_found_rate": S.ratio("n_face_found_videos", "n_total_videos")})


def exclusions(videos: DataFrame, keys: list[str]) -> DataFrame:
    """A row for each video without a score or with a partial one, and why."""
    details = F.when(~F.col("score_available"), "No scored frames after aggregation").otherwise(F.concat(F.lit("Scored "), F.col("n_frames_scored").cast("string"), F.lit(" of "), F.col("n_frames_expected").cast("string"), F.lit(" expected frames")))
    return videos.where(~F.col("score_available") | F.col("partial_score")).select(*keys, F.col("failure_stage").alias("stage"), F.col("failure_reason").alias("reason_code"), details.alias("details"))
