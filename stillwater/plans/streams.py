"""Queries over logs that are read as streams to their end."""

from __future__ import annotations

from pyspark.sql import functions as F

from stillwater.plans.fixtures import query, read, scratch
from stillwater.streaming import resume

# the log of all events of a user: errors are failed attempts; users divisible by 11 were expected but never tried
_LOG = "l AS (SELECT CAST(user_id AS VARCHAR) AS key, event_id AS seq, CASE WHEN event_type = 'error' THEN 'failed' ELSE 'ok' END AS status FROM events WHERE user_id % 11 <> 0)"
_STATES = f"{_LOG}, t AS (SELECT *, lag(status) OVER (PARTITION BY key ORDER BY seq) AS before FROM l), states AS (SELECT key, max(seq) AS seq, arg_max(status, seq) AS status, count(*) AS attempts, count(*) FILTER (before = 'failed' AND status = 'ok') AS recovered, count(*) FILTER (before = 'ok' AND status = 'failed') AS redone FROM t GROUP BY key)"


def _states(spark, sf):
    """The log arrives in two parts; the second run goes on from the first one's checkpoint."""
    events = read(spark, sf, "events").where("user_id % 11 <> 0").select(F.col("user_id").cast("string").alias("key"), F.col("event_id").alias("seq"), F.when(F.col("event_type") == "error", "failed").otherwise("ok").alias("status"))
    middle = events.agg(F.expr("percentile_approx(seq, 0.5)")).first()[0] or 0
    log, out, checkpoint = (scratch(spark, f"log-{n}") for n in ("records", "states", "checkpoint"))
    for part in (F.col("seq") <= middle, F.col("seq") > middle):
        events.where(part).write.mode("append").json(log)
        resume.advance(spark, log, out, checkpoint)
    return resume.current(spark, out)


@query("snk_06_stream", f"WITH {_STATES} SELECT key, seq, status, attempts, recovered, redone, CAST(0 AS BIGINT) AS stale FROM states")
def snk_06_stream(spark, sf):
    """Last record, attempts and changes of each key, from the stream's state."""
    return _states(spark, sf)


@query("snk_06_pending", f"WITH {_STATES}, e AS (SELECT DISTINCT CAST(user_id AS VARCHAR) AS key FROM events) SELECT key, coalesce(status, 'missing') AS status FROM e LEFT JOIN states USING (key) WHERE coalesce(status <> 'ok', TRUE)")
def snk_06_pending(spark, sf):
    """What a resumed run still has to do."""
    expected = read(spark, sf, "events").select(F.col("user_id").cast("string").alias("key")).distinct()
    return resume.pending(expected, _states(spark, sf))
