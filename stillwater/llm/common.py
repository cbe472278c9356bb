"""Helpers shared by the corpus operators: shared folders, heavy keys, word splitting."""

from __future__ import annotations

import atexit
import gc
import hashlib
import os
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: At most this many keys can each hold 1/HEAVY_PARTS of the rows, so a table of them is safe to broadcast.
HEAVY_PARTS = 512

_SHIPPED: set[str] = set()
_LOCAL: dict[str, str] = {}


def prepare(spark: SparkSession, batch: int = 4 << 20) -> SparkSession:
    """Bound the Arrow batches by bytes (texts differ in length) and make the package importable on executors."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(batch))
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    app = spark.sparkContext.applicationId
    on_path = any(p and os.path.abspath(p) == root for p in os.environ.get("PYTHONPATH", "").split(os.pathsep))
    if app not in _SHIPPED and not on_path:
        folder = tempfile.mkdtemp(prefix="stillwater-code-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        archive = os.path.join(folder, "stillwater.zip")
        with zipfile.ZipFile(archive, "w") as out:
            package = os.path.join(root, "stillwater")
            for top, _, names in os.walk(package):
                for name in names:
                    if name.endswith(".py"):
                        full = os.path.join(top, name)
                        out.write(full, os.path.relpath(full, root))
        spark.sparkContext.addPyFile(archive)
    _SHIPPED.add(app)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or with a local master a folder of our own."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names no folder that driver and executors share")
        app = spark.sparkContext.applicationId
        if app not in _LOCAL:
            _LOCAL[app] = tempfile.mkdtemp(prefix="stillwater-shared-")
            atexit.register(shutil.rmtree, _LOCAL[app], ignore_errors=True)
            spark.sparkContext.setCheckpointDir(_LOCAL[app])
        folder = _LOCAL[app]
    return folder if "://" in folder or folder.startswith("file:") else f"file://{os.path.abspath(folder)}"


class Scratch:
    """Tables and files of one run of an operator, in the shared folder."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"

    def sub(self, name: str) -> str:
        return f"{self.path}/{name}"

    def table(self, df: DataFrame, name: str) -> DataFrame:
        """Write df once and read it back: cuts the lineage and outlives lost executors."""
        df.write.option("compression", "zstd").parquet(self.sub(name))
        return self.spark.read.schema(df.schema).parquet(self.sub(name))

    def drop(self, name: str) -> None:
        """Delete a table that no later step reads."""
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.sub(name))
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner delete the shuffle files of finished steps: it acts when the driver collects its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def released(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches, after each of which Arrow gives back the memory that it holds for later."""
    for batch in batches:
        yield batch
        pa.default_memory_pool().release_unused()


def split_heavy(groups: DataFrame, count: str, total: int) -> tuple[DataFrame, DataFrame]:
    """Split a table of one row a key by the key's share of all rows.

    A key is heavy from 1/HEAVY_PARTS of ``total`` rows on, so there are HEAVY_PARTS heavy keys at most.
    """
    limit = max(2, total // HEAVY_PARTS)
    return groups.where(F.col(count) >= limit), groups.where(F.col(count) < limit)


def heavy_light_join(rows: DataFrame, groups: DataFrame, keys: list[str], count: str, total: int) -> DataFrame:
    """Inner join of rows with one row a key: heavy keys by broadcast, all others by shuffle.

    Neither side may have null keys.  ``count`` is dropped from neither side.
    """
    heavy, light = split_heavy(groups, count, total)
    marks = heavy.select(*keys, F.lit(True).alias("_heavy"))
    marked = rows.join(F.broadcast(marks), keys, "left")
    hot = marked.where("_heavy").drop("_heavy").join(F.broadcast(heavy), keys)
    cold = marked.where("_heavy is null").drop("_heavy").join(light, keys)
    return hot.unionByName(cold)


def attach(rows: DataFrame, groups: DataFrame, key: str, count: str, total: int, columns: list[str], spread: list[str]) -> DataFrame:
    """Left join of rows with one row a key, by a string key: heavy keys by broadcast, the others by shuffle.

    Rows that found a heavy key are dealt by ``spread`` instead of by their key, so no key fills a partition.
    """
    heavy, light = split_heavy(groups, count, total)
    hot = heavy.select(key, F.lit(True).alias("_hot"), *(F.col(c).alias(f"_hot_{c}") for c in columns))
    marked = rows.join(F.broadcast(hot), key, "left")
    dealt = F.when(F.col("_hot"), F.concat(F.lit("#"), F.xxhash64(*spread).cast("string"))).otherwise(F.col(key))
    cold = light.select(F.col(key).alias("_key"), *(F.col(c).alias(f"_cold_{c}") for c in columns))
    joined = marked.withColumn("_key", dealt).join(cold, "_key", "left")
    return joined.select(*(F.col(c) for c in rows.columns), *(F.coalesce(f"_hot_{c}", f"_cold_{c}").alias(c) for c in columns))


def packed(rows: DataFrame, column: str = "text") -> DataFrame:
    """The rows with a text column as zstd frames, for texts that have to move; ``unpack`` undoes it."""

    def run(batches):
        for batch in batches:
            k = batch.schema.get_field_index(column)
            small = zstandard.ZstdCompressor(level=1)
            data = pa.array([small.compress(x.encode("utf-8", "surrogatepass")) for x in batch.column(k).to_pylist()], pa.binary())
            yield batch.set_column(k, column, data)

    schema = T.StructType([T.StructField(f.name, T.BinaryType()) if f.name == column else f for f in rows.schema])
    return rows.mapInArrow(run, schema)


def unpack(values: Iterable[bytes]) -> Iterator[str]:
    big = zstandard.ZstdDecompressor()
    return (big.decompress(x).decode("utf-8", "surrogatepass") for x in values)


def text_of(column: str = "text") -> Column:
    """The text, empty for null."""
    return F.coalesce(F.col(column), F.lit(""))


def text_key(column: str = "text") -> Column:
    """The SHA-256 of the text: with doc_id it tells all rows apart but those that repeat both."""
    return F.unhex(F.sha2(text_of(column).cast("binary"), 256))


def drop_by_key(docs: DataFrame, verdicts: DataFrame, scratch: Scratch) -> DataFrame:
    """docs, with all their columns, without the rows that are not kept; of rows that repeat doc_id and text, one.

    ``verdicts`` has a row a document: doc_id, own (its text_key), kept.  Documents without any stay as they are.
    """
    keys = verdicts.groupBy(F.col("doc_id").alias("_id"), F.col("own").alias("_own")).agg(F.max("kept").alias("_kept"), F.count("*").alias("_n"))
    keys = scratch.table(keys.where("not _kept or _n > 1").drop("_n"), "keys")
    several = keys.where("_kept")
    same = F.col("_doc").eqNullSafe(F.col("_id")) & (F.col("_text") == F.col("_own"))
    whole = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_whole")  # so no column's name can clash
    marked = docs.select(whole, F.col("doc_id").cast("long").alias("_doc"), text_key().alias("_text"))
    stay = marked.join(keys, same, "left_anti").select("_whole.*")
    if several.isEmpty():
        return stay
    one = marked.join(several, same, "left_semi").groupBy("_doc", "_text").agg(F.min("_whole").alias("_whole"))
    return stay.unionByName(one.select("_whole.*"))


def mix64(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64 on an array of uint64."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


#: ASCII letters to lower case; every byte that is no letter, digit or part of a non-ASCII character to a space.
LETTERS = bytes(i if 48 <= i < 58 or 97 <= i < 123 or i >= 128 else i + 32 if 65 <= i < 91 else 32 for i in range(256))
#: ASCII letters to lower case, the rest unchanged.
LOWER = bytes(i + 32 if 65 <= i < 91 else i for i in range(256))


def letter_words(text: str | None) -> list[bytes]:
    """Words of ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z, as UTF-8."""
    return text.encode("utf-8", "surrogatepass").translate(LETTERS).split() if text else []


def space_words(text: str | None, lower: bool = False) -> list[bytes]:
    """Words of ``[^\\x20\\x09-\\x0D]+`` as UTF-8 (bytes.split cuts at just these six bytes)."""
    if not text:
        return []
    raw = text.encode("utf-8", "surrogatepass")
    return (raw.translate(LOWER) if lower else raw).split()


def int64(values: np.ndarray) -> np.ndarray:
    return values.view(np.int64)


_BASE = np.uint64(0x9E3779B97F4A7C15)
_SPACE = np.isin(np.arange(256), [0x20, 9, 10, 11, 12, 13])
#: Masks of the first k bytes of eight.
_FIRST = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
#: Longer words are hashed one by one.
_LONG_WORD = 512


def word_hashes(texts: list[str | None], lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of ``[^\\x20\\x09-\\x0D]+`` in a row, and how many each text has.

    Eight bytes of all words at a time are mixed into their hashes, so no word becomes an object of its own; words of more
    than ``_LONG_WORD`` bytes are hashed by blake2b.
    """
    hashes, sizes, block, size = [], [], [], 0
    for k, text in enumerate(texts):
        raw = text.encode("utf-8", "surrogatepass") if text else b""
        block.append(raw.translate(LOWER) if lower else raw)
        size += len(raw) + 1
        if size >= 1 << 20 or k == len(texts) - 1:
            own, n = _block_hashes(block)
            hashes.append(own)
            sizes.append(n)
            block, size = [], 0
    return (np.concatenate(hashes), np.concatenate(sizes)) if hashes else (np.zeros(0, np.uint64), np.zeros(0, np.int64))


def _block_hashes(block: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(b" ".join(block) + b" ", np.uint8)
    blank = _SPACE[raw]
    edge = np.flatnonzero(np.diff(blank, prepend=True))  # a word begins, a word ends, and so on
    begin, end = edge[::2], edge[1::2]
    eights = np.ndarray(len(raw), np.dtype("<u8"), raw.tobytes() + bytes(8), strides=(1,))  # from each byte on
    length = end - begin
    own = mix64(length.astype(np.uint64) * _BASE + np.uint64(1))
    long = np.flatnonzero(length > _LONG_WORD)
    some = np.flatnonzero(length <= _LONG_WORD) if len(long) else np.arange(len(begin))
    at = 0
    while len(some):
        rest = length[some] - at
        own[some] = mix64((own[some] ^ (eights[begin[some] + at] & _FIRST[np.minimum(rest, 8)])) + _BASE)
        some = some[rest > 8]
        at += 8
    for k in long.tolist():
        own[k] = int.from_bytes(hashlib.blake2b(raw[begin[k] : end[k]].tobytes(), digest_size=8).digest(), "little")
    first = np.cumsum([0] + [len(b) + 1 for b in block])
    return own, np.diff(np.searchsorted(begin, first))
