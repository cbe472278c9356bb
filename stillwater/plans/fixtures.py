"""The shared tables in the study's shapes: as DataFrames, and as common table expressions for DuckDB."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from stillwater.operators import thresholds, videos

DETECTORS = ("raw", "draw", "mean")
VIDEO_KEYS = ["detector", "dataset", "role", "video", "study_label", "manipulation", "condition"]

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query and its SQL."""

    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return add


def read(spark: SparkSession, sf: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{table}.parquet")


def scratch(spark, name):
    """A new folder that driver and executors share; only a local master may do without spark.checkpoint.dir."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names no folder that driver and executors share")
        root = tempfile.gettempdir()
    return f"{root.rstrip('/')}/study-{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written once and read back, for small tables that a query uses many times."""
    df.write.parquet(path := scratch(df.sparkSession, name))
    return df.sparkSession.read.schema(df.schema).parquet(path)


def numbered(rows: DataFrame, order: list, name: str = "place") -> DataFrame:
    """rows with their place from 1 on in an order without ties.  They are numbered inside ranges of the order, and the rows
    of all ranges before are added from a table of one row a range, so no task sees all rows.
    """
    dealt = stored(rows.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "ranges")
    sizes = dealt.groupBy("_part").agg(F.count("*").alias("_n"))
    before = sizes.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    own = dealt.withColumn("_r", F.row_number().over(Window.partitionBy("_part").orderBy(*order)))
    return own.join(F.broadcast(before), "_part").select(*rows.columns, (F.col("_r") + F.col("_before")).alias(name))


def r9(df: DataFrame, digits: int = 9) -> DataFrame:
    """Doubles rounded, so that the order of a sum doesn't show."""
    return df.select(*(F.round(f.name, digits).alias(f.name) if isinstance(f.dataType, T.DoubleType) else f.name for f in df.schema))


def split_columns(expressions: str) -> list[str]:
    """The columns of a select list, which may hold commas in brackets."""
    out, depth = [""], 0
    for c in expressions:
        depth += (c == "(") - (c == ")")
        if c == "," and not depth:
            out.append("")
        else:
            out[-1] += c
    return [x.strip() for x in out]


def base(spark: SparkSession, sf: str) -> DataFrame:
    user = F.col("user_id")
    label = F.expr("cast((user_id div 3) % 2 as int)")
    condition = F.when(F.col("event_type") == "view", "CLN").when(F.col("event_type") == "click", "RSZ").when(F.col("event_type") == "error", "BLR").when(F.col("event_type") == "purchase", "H40").otherwise("PLT")
    order = Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id")
    return read(spark, sf, "events").select(
        user.alias("video"),
        "event_id",
        condition.alias("condition"),
        F.when(user % 3 == 0, "validation").when(user % 3 == 1, "test").otherwise("external_evaluation").alias("role"),
        F.when(user % 3 == 2, "second").otherwise("first").alias("dataset"),
        label.alias("study_label"),
        F.when((label == 1) & (user % 3 != 2), F.expr("concat('M', cast((user_id div 6) % 4 + 1 as string))")).otherwise("").alias("manipulation"),
        (F.row_number().over(order) - 1).alias("temporal_position"),
        F.least(F.col("value") / 500.0, F.lit(1.0)).alias("s"),
        (F.conv(F.substring(F.md5(F.concat(F.lit("draw::"), F.col("event_id").cast("string"))), 1, 8), 16, 10).cast("long") / F.lit(4294967296.0)).alias("r"),
        F.when(F.col("event_id") % 97 == 0, "failed").otherwise("ok").alias("inference_status"),
    )


BASE = """base AS (SELECT user_id AS video, event_id,
  CASE event_type WHEN 'view' THEN 'CLN' WHEN 'click' THEN 'RSZ' WHEN 'error' THEN 'BLR' WHEN 'purchase' THEN 'H40' ELSE 'PLT' END AS condition,
  CASE user_id % 3 WHEN 0 THEN 'validation' WHEN 1 THEN 'test' ELSE 'external_evaluation' END AS role,
  CASE WHEN user_id % 3 = 2 THEN 'second' ELSE 'first' END AS dataset,
  CAST((user_id // 3) % 2 AS INTEGER) AS study_label,
  CASE WHEN (user_id // 3) % 2 = 1 AND user_id % 3 <> 2 THEN 'M' || CAST((user_id // 6) % 4 + 1 AS VARCHAR) ELSE '' END AS manipulation,
  CAST(row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) - 1 AS INTEGER) AS temporal_position,
  least(value / CAST(500 AS DOUBLE), CAST(1 AS DOUBLE)) AS s,
  CAST(('0x' || substr(md5('draw::' || event_id), 1, 8)) AS BIGINT) / CAST(4294967296 AS DOUBLE) AS r,
  CASE WHEN event_id % 97 = 0 THEN 'failed' ELSE 'ok' END AS inference_status FROM events)"""


def frames(spark: SparkSession, sf: str) -> DataFrame:
    each = base(spark, sf).withColumn("detector", F.explode(F.array(*map(F.lit, DETECTORS))))
    score = F.when(F.col("detector") == "raw", F.col("s")).when(F.col("detector") == "draw", F.col("r")).otherwise((F.col("s") + F.col("r")) / 2)
    return each.withColumn("score", score).drop("s", "r")


FRAMES = (
    BASE
    + """, frames AS (SELECT b.* EXCLUDE (s, r), d.detector, CASE d.detector WHEN 'raw' THEN s WHEN 'draw' THEN r ELSE (s + r) / 2 END AS score
  FROM base b, (VALUES ('raw'), ('draw'), ('mean')) d(detector))"""
)


def plan(spark: SparkSession, sf: str) -> DataFrame:
    """Planned positions of each video: as many as its shortest condition has."""
    n = base(spark, sf).groupBy("video", "condition").count().groupBy("video").agg(F.min("count").alias("n"))
    return n.select("video", F.sequence(F.lit(0), (F.col("n") - 1).cast("int")).alias("positions"))


PLAN = FRAMES + ", plan AS (SELECT video, min(n) AS n FROM (SELECT video, condition, count(*) AS n FROM base GROUP BY ALL) GROUP BY video)"


def planned_frames(spark: SparkSession, sf: str) -> DataFrame:
    p = plan(spark, sf).select("video", F.size("positions").alias("n"))
    return frames(spark, sf).join(p, "video").where("temporal_position < n").drop("n")


def video_scores(spark: SparkSession, sf: str) -> DataFrame:
    return videos.strict_scores(planned_frames(spark, sf), plan(spark, sf), VIDEO_KEYS, ["video"], "temporal_position")


VIDEOS = (
    PLAN
    + """, videos AS (SELECT detector, dataset, role, video, study_label, manipulation, condition, max(n) AS n, count(*) FILTER (inference_status = 'ok') AS n_ok,
  CASE WHEN count(*) FILTER (inference_status <> 'ok') = 0 THEN avg(score) END AS video_score
  FROM frames JOIN plan USING (video) WHERE temporal_position < n GROUP BY ALL)"""
)


def calibration(scores: DataFrame) -> DataFrame:
    """Valid clean real validation videos."""
    return scores.where("dataset = 'first' and role = 'validation' and condition = 'CLN' and study_label = 0 and video_score is not null")


def frozen(scores: DataFrame) -> DataFrame:
    return thresholds.low_fpr(calibration(scores).withColumn("score", F.col("video_score")), ["detector"])


def threshold_sql(source: str, keys: str, score: str = "score", name: str = "cut", num: int = 5) -> str:
    """The lowest admissible threshold by key, from a histogram and a running sum."""
    return f"""{name}_h AS (SELECT {keys}, {score} AS score, count(*) AS n FROM {source} GROUP BY ALL),
{name}_c AS (SELECT *, sum(n) OVER (PARTITION BY {keys} ORDER BY score DESC) AS c, sum(n) OVER (PARTITION BY {keys}) AS t FROM {name}_h),
{name} AS (SELECT {keys}, coalesce(min(CASE WHEN c <= ({num} * t) // 100 THEN score END), nextafter(max(score), 'infinity'::DOUBLE)) AS threshold_value,
  CAST(max(t) AS BIGINT) AS n_real, CAST(coalesce(max(CASE WHEN c <= ({num} * t) // 100 THEN c END), 0) AS BIGINT) AS false_positives, CAST(({num} * max(t)) // 100 AS BIGINT) AS max_allowed, count(*) + 1 AS candidates FROM {name}_c GROUP BY {keys})"""


CUT = VIDEOS + ", calib AS (SELECT * FROM videos WHERE dataset = 'first' AND role = 'validation' AND condition = 'CLN' AND study_label = 0 AND video_score IS NOT NULL), " + threshold_sql("calib", "detector", "video_score")


def decisions(spark: SparkSession, sf: str) -> DataFrame:
    scores = stored(video_scores(spark, sf), "scores")
    return stored(thresholds.decide(scores, frozen(scores), ["detector"]), "decisions")


DECISIONS = CUT + ", decisions AS (SELECT v.*, threshold_value, CAST(video_score >= threshold_value AS INTEGER) AS decision FROM videos v LEFT JOIN cut USING (detector))"

FAN = (
    DECISIONS
    + """, fan AS (SELECT *, unnest(CASE WHEN dataset = 'second' THEN ['pooled'] WHEN study_label = 0 THEN ['M1', 'M2', 'M3', 'M4', 'pooled'] ELSE [manipulation, 'pooled'] END) AS metric_group
  FROM decisions WHERE NOT (dataset = 'first' AND role = 'validation'))"""
)

GROUP = "detector, dataset, role, condition, metric_group"


def auc_sql(source: str, keys: str, score: str, label: str, name: str, weight: str = "1") -> str:
    """Tie-aware AUC by key from mid-ranks."""
    over = f"PARTITION BY {keys} ORDER BY s" if keys else "ORDER BY s"
    lead = f"{keys}, " if keys else ""
    tail = f" GROUP BY {keys}" if keys else ""
    return f"""{name}_h AS (SELECT {lead}{score} AS s, sum(CASE WHEN {label} = 1 THEN {weight} ELSE 0 END) AS p, sum(CASE WHEN {label} = 0 THEN {weight} ELSE 0 END) AS q FROM {source} WHERE {score} IS NOT NULL GROUP BY ALL),
{name}_m AS (SELECT *, sum(q) OVER ({over}) - q / 2.0 AS mid FROM {name}_h),
{name} AS (SELECT {lead}CASE WHEN sum(p) * sum(q) > 0 THEN CAST(sum(p * mid) AS DOUBLE) / CAST(sum(p) * sum(q) AS DOUBLE) END AS auc, CAST(sum(q) AS BIGINT) AS n_real, CAST(sum(p) AS BIGINT) AS n_manipulated FROM {name}_m{tail})"""


def rates_sql(source: str, keys: str, label: str, decision: str, name: str, weight: str = "1") -> str:
    c = {k: f"CAST(sum(CASE WHEN {label} = {a} AND {decision} = {b} THEN {weight} ELSE 0 END) AS BIGINT)" for k, (a, b) in {"tp": (1, 1), "fp": (0, 1), "tn": (0, 0), "fn": (1, 0)}.items()}
    return f"""{name}_n AS (SELECT {keys}, {", ".join(f"{v} AS {k}" for k, v in c.items())} FROM {source} WHERE {decision} IS NOT NULL GROUP BY {keys}),
{name} AS (SELECT *, (fpr + fnr) / 2 AS hter FROM (SELECT *, CASE WHEN fp + tn > 0 THEN fp / (fp + tn) END AS fpr, CASE WHEN fn + tp > 0 THEN fn / (fn + tp) END AS fnr FROM {name}_n))"""


PAIRS = (
    DECISIONS
    + """, ok AS (SELECT * FROM decisions WHERE decision IS NOT NULL AND video_score IS NOT NULL),
pairs AS (SELECT b.*, c.video_score AS clean_score, c.decision AS clean_decision FROM ok b JOIN ok c USING (detector, dataset, role, video) WHERE b.condition <> 'CLN' AND c.condition = 'CLN'),
pfan AS (SELECT *, unnest(CASE WHEN dataset = 'second' THEN ['pooled'] WHEN study_label = 0 THEN ['M1', 'M2', 'M3', 'M4', 'pooled'] ELSE [manipulation, 'pooled'] END) AS metric_group
  FROM pairs WHERE NOT (dataset = 'first' AND role = 'validation'))"""
)

