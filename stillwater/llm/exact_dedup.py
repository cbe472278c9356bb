"""Exact dedup by content-defined chunk recipes.

Each text (white space removed, see ``SPACE``) is cut where a rolling hash of its last 32 bytes says so, so equal
passages are cut alike wherever they stand.  A document becomes its recipe, the ordered list of its chunks'
identifiers.  The bytes of a chunk move once, to verify that equal hashes mean equal bytes: contents that collide get a
number of their own.  Documents are then compared by these short lists alone.

Null text counts as empty, and all empty texts are equal.  Rows without doc_id come last when a group chooses the row
that stays.  One row of a group is kept, whether its rows repeat doc_id, text, both or have no doc_id.  Other columns are read
only by ``drop_exact_copies``, to choose among rows that repeat both.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stillwater.llm import common

#: The characters that do not count: space and \x09-\x0D.
SPACE = b"\x20\x09\x0a\x0b\x0c\x0d"
MIN_CHUNK, MASK_BITS, MAX_CHUNK = 256, 10, 8192

_GEAR = (common.mix64(np.arange(1, 257, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32)

SCHEMA = "doc_id long, n_chars long, text_sha256 string, own binary, chunk_hashes array<long>, pieces array<binary>"


def cut_points(raw: bytes) -> list[int]:
    """Ends of the chunks of raw; every chunk but the last has MIN_CHUNK to MAX_CHUNK bytes."""
    n = len(raw)
    if n <= MIN_CHUNK:
        return [n] if n else []
    h = _GEAR[np.frombuffer(raw, np.uint8)]
    for step in (1, 2, 4, 8, 16):
        shifted = h[:-step] << np.uint32(step)
        h = h.copy()
        h[step:] += shifted
    marks = np.flatnonzero(h >> np.uint32(32 - MASK_BITS) == 0) + 1
    ends, last = [], 0
    for m in marks.tolist():
        while m - last > MAX_CHUNK:
            last += MAX_CHUNK
            ends.append(last)
        if m - last >= MIN_CHUNK and m < n:
            ends.append(m)
            last = m
    while n - last > MAX_CHUNK:
        last += MAX_CHUNK
        ends.append(last)
    return [*ends, n]


def chunk_hash(piece: bytes, bits: int) -> int:
    """A signed 64-bit hash, of which ``bits`` bits are used."""
    return int.from_bytes(hashlib.blake2b(piece, digest_size=8).digest(), "little", signed=True) >> (64 - bits)


def _recipes(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes, digests, hashes, pieces = [], [], [], []
        for text in batch.column(1).to_pylist():
            sizes.append(len(text))
            raw = text.encode("utf-8", "surrogatepass").translate(None, SPACE)
            digests.append(hashlib.sha256(raw).hexdigest())
            ends = cut_points(raw)
            own = [raw[a:b] for a, b in zip([0, *ends], ends, strict=False)]
            pieces.append(own)
            hashes.append([chunk_hash(p, bits) for p in own])
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(sizes, pa.int64()), pa.array(digests, pa.string()), batch.column(2), pa.array(hashes, pa.list_(pa.int64())), pa.array(pieces, pa.list_(pa.binary()))],
            names=["doc_id", "n_chars", "text_sha256", "own", "chunk_hashes", "pieces"],
        )


def recipes(docs: DataFrame, scratch: common.Scratch, bits: int = 64, keyed: bool = False) -> DataFrame:
    """One row a document: doc_id, n_chars, text_sha256, own (its text_key, null unless keyed), at (a number of the row), recipe
    (ordered verified chunk identifiers).
    """
    own = common.text_key() if keyed else F.lit(None).cast("binary")
    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), common.text_of().alias("text"), own.alias("own"))
    chunked = scratch.table(chosen.mapInArrow(lambda it: _recipes(it, bits), SCHEMA).withColumn("at", F.monotonically_increasing_id()), "chunks")
    contents = chunked.select(F.explode(F.arrays_zip("chunk_hashes", "pieces")).alias("c")).select(F.col("c.chunk_hashes").alias("hash"), F.col("c.pieces").alias("piece")).distinct()
    clashing = contents.groupBy("hash").agg(F.count("*").alias("n")).where("n > 1").select("hash")
    clashing = scratch.table(clashing, "clashing")
    base = chunked.select("doc_id", "n_chars", "text_sha256", "own", "at", F.expr("transform(chunk_hashes, h -> struct(h as hash, 0 as variant))").alias("recipe"))
    if clashing.isEmpty():  # each hash has one content, so the hash is the identifier
        return base
    # Rows of documents with a clashing hash are few; their chunks are numbered by content.
    from pyspark.sql import Window

    numbered = contents.join(clashing, "hash").withColumn("variant", (F.row_number().over(Window.partitionBy("hash").orderBy("piece")) - 1).cast("int"))
    rows = chunked.withColumn("row", F.xxhash64("doc_id", "text_sha256"))
    each = rows.select("doc_id", "n_chars", "text_sha256", "row", F.posexplode(F.arrays_zip("chunk_hashes", "pieces")).alias("pos", "c")).dropDuplicates(["doc_id", "text_sha256", "pos"])
    named = each.select("doc_id", "text_sha256", "pos", F.col("c.chunk_hashes").alias("hash"), F.col("c.pieces").alias("piece")).join(numbered, ["hash", "piece"], "left")
    lists = named.groupBy("doc_id", "text_sha256").agg(F.sort_array(F.collect_list(F.struct("pos", "hash", F.coalesce("variant", F.lit(0)).alias("variant")))).alias("l"))
    lists = lists.select("doc_id", "text_sha256", F.expr("transform(l, x -> struct(x.hash as hash, x.variant as variant))").alias("r"))
    a, b = base.alias("a"), lists.alias("b")
    joined = a.join(b, F.col("a.doc_id").eqNullSafe(F.col("b.doc_id")) & (F.col("a.text_sha256") == F.col("b.text_sha256")), "left")
    return joined.select("a.doc_id", "a.n_chars", "a.text_sha256", "a.own", "a.at", F.coalesce("b.r", "a.recipe").alias("recipe"))


def _judged(docs: DataFrame, scratch: common.Scratch, bits: int, keyed: bool) -> DataFrame:
    """The rows of recipes with their group's keep_id, keep_own, keep_at and group_size."""
    rows = recipes(docs, scratch, bits, keyed)
    order = F.struct(F.negative("n_chars").alias("a"), F.col("doc_id").isNull().alias("b"), F.col("doc_id").alias("c"), F.col("own").alias("d"), F.col("at").alias("e"))
    groups = rows.groupBy("recipe").agg(F.min(order).alias("best"), F.count("*").alias("group_size"))
    groups = scratch.table(groups.select("recipe", F.col("best.c").alias("keep_id"), F.col("best.d").alias("keep_own"), F.col("best.e").alias("keep_at"), "group_size"), "groups")
    total = groups.agg(F.sum("group_size")).first()[0] or 0
    return common.heavy_light_join(rows, groups, ["recipe"], "group_size", total)


def exact_groups(docs: DataFrame, bits: int = 64) -> DataFrame:
    """One row a document: doc_id, keep_id, group_size, kept, text_sha256, n_chunks.

    The document with the most characters stays, of those the one with the smallest doc_id.
    ``bits`` shortens the chunk hashes, for tests of colliding chunks.
    """
    spark = common.prepare(docs.sparkSession)
    joined = _judged(docs, common.Scratch(spark, "exact_dedup"), bits, keyed=False)
    return joined.select("doc_id", "keep_id", "group_size", (F.col("at") == F.col("keep_at")).alias("kept"), "text_sha256", F.size("recipe").alias("n_chunks"))


def drop_exact_copies(docs: DataFrame, bits: int = 64) -> DataFrame:
    """The one row of each group that stays, with all its columns."""
    spark = common.prepare(docs.sparkSession)
    scratch = common.Scratch(spark, "exact_dedup")
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("own") == F.col("keep_own"))
    return common.drop_by_key(docs, _judged(docs, scratch, bits, keyed=True).select("doc_id", "own", kept.alias("kept")), scratch)
