"""Bounded, reproducible samples of labelled rows for fitting classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

FOLDS = 5
#: At most so many bytes of labelled texts come to the driver.
MOST_BYTES = 64 << 20


def held_out(doc_id: str = "doc_id") -> Column:
    """True where crc32 of the doc_id's text divides by FOLDS; such rows are never learnt from.  Null: held out."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(FOLDS)) == 0, F.lit(True))


def turn() -> Column:
    """A place from 0 to 999,999 that a hash of doc_id gives."""
    return F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000))


def bounded(rows: DataFrame, most_bytes: int = MOST_BYTES) -> list[Row]:
    """Rows of a sample (doc_id, text and others; one row a doc_id) in order of doc_id: all, or where their texts have more
    than ``most_bytes``, those that fit when taken by ``turn``.
    """
    rows = rows.persist()
    taken, left, size = [], False, 0
    for row in rows.select("doc_id", turn().alias("turn"), F.octet_length("text").alias("bytes")).orderBy("turn", "doc_id").collect():
        if size + row["bytes"] <= most_bytes:
            taken.append((row["doc_id"],))
            size += row["bytes"]
        else:
            left = True
    kept = rows.join(F.broadcast(rows.sparkSession.createDataFrame(taken, "doc_id long")), "doc_id") if left else rows
    found = sorted(kept.collect(), key=lambda r: r["doc_id"])
    rows.unpersist()
    return found


def fit_rows(docs: DataFrame, labels: DataFrame, label: str, most: int) -> list[tuple[str, int]]:
    """About ``most`` labelled texts (text, 0 or 1) that aren't held out, chosen by a hash of doc_id.

    The share that is taken shrinks as labels grow, so what comes to the driver is bounded by ``most`` in rows and by
    MOST_BYTES in bytes.  Null labels and null texts teach nothing.  Of a doc_id that is labelled twice, the smaller label
    counts; of one that has several texts, the first in byte order.
    """
    usable = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label")).where("label is not null and doc_id is not null")
    usable = usable.where(~held_out()).groupBy("doc_id").agg(F.min("label").alias("label"))
    n = usable.count()
    chosen = usable.where(turn() < int(min(1.0, most / max(n, 1)) * 1_000_000))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("text is not null")
    rows = bounded(texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text")))
    return [(r["text"], r["label"]) for r in rows]
