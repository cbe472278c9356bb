"""A resume log as a stream: workers append one JSON record an attempt, and the last record of each key is its state.

The state of a key is kept by Structured Streaming, so a run reads only files that no run before has read, and a run that was
stopped goes on from the checkpoint.  Each micro-batch writes the keys that it changed to a folder of its own number, which a
repeated batch overwrites; ``current`` takes each key's newest row.

Records may come in any order inside a micro-batch.  One that is older than a key's state (a smaller ``seq``) is counted as
stale and changes nothing else.  Records without key or status are left out; of records that repeat key and seq, all count
as attempts.  A task holds seq and status of one key's records of one micro-batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: Statuses after which a key isn't tried again.
DONE = ("ok",)
RECORD = "key string, seq long, status string"
STATE = "seq long, status string, attempts long, recovered long, redone long, stale long"
COLUMNS = ("key", "seq", "status", "attempts", "recovered", "redone", "stale")


def _advance(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    seq, status, attempts, recovered, redone, stale = state.get if state.exists else (None, None, 0, 0, 0, 0)
    # a key has few records, so lists: concatenating and sorting frames would cost more than all else
    for own, now in sorted(r for f in frames for r in zip(f["seq"].tolist(), f["status"].tolist(), strict=True)):
        attempts += 1
        if seq is not None and own < seq:
            stale += 1
            continue
        if status is not None:
            recovered += status not in DONE and now in DONE
            redone += status in DONE and now not in DONE
        seq, status = own, now
    values = (int(seq), status, attempts, int(recovered), int(redone), stale)
    state.update(values)
    yield pd.DataFrame(dict(zip(COLUMNS, ((v,) for v in (key[0], *values)), strict=True)))


def advance(spark: SparkSession, log: str, out: str, checkpoint: str, files_per_batch: int | None = None) -> None:
    """Read what the log has had appended since the last run, to its end, and stop."""
    spark.createDataFrame([], f"key string, {STATE}").write.mode("overwrite").parquet(f"{out}/batch=-1")  # so that an empty log has states: none
    reader = spark.readStream.schema(RECORD)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    records = reader.json(log).where("key is not null and seq is not null and status is not null")
    states = records.groupBy("key").applyInPandasWithState(_advance, f"key string, {STATE}", STATE, "update", GroupStateTimeout.NoTimeout)

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    states.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def current(spark: SparkSession, out: str) -> DataFrame:
    """The state of each key: key, seq, status, attempts, recovered (failed, then done), redone (done, then failed), stale."""
    rows = spark.read.schema(f"key string, {STATE}, batch int").option("basePath", out).parquet(out)
    names = ["seq", "status", "attempts", "recovered", "redone", "stale"]
    return rows.groupBy("key").agg(F.max_by(F.struct(*names), "batch").alias("r")).select("key", *(F.col(f"r.{n}").alias(n) for n in names))


def pending(expected: DataFrame, states: DataFrame) -> DataFrame:
    """Expected keys (column key) that are still to do, with what became of them: missing, or their last status."""
    known = states.select("key", "status")
    return expected.join(known, "key", "left").where(~F.coalesce(F.col("status").isin(*DONE), F.lit(False))).withColumn("status", F.coalesce("status", F.lit("missing")))
