"""Token ids in binary files: canonical length-limited Huffman codes, table-driven decoding.

Codes come from the counts of all ids: package-merge gives lengths of at most ``limit`` bits, and the canonical order
makes the lengths alone the whole code table.  A file holds blocks that decode without each other.  A block holds the
documents' bits one after another, each document from a whole byte on, and the bit offsets of checkpoints: the start of
each document and every ``CHECKPOINT`` ids after it.  All checkpoints of a block are decoded side by side, a table
look-up an id.

Folder: ``_codes`` (ids and code lengths), ``_files`` (committed files in ascending order of doc_id, with the number of
ids before each), ``part-*.huf``.  Files that a lost task left behind are in no list and never read.

Null texts are empty: their document is its end id alone.  Rows without doc_id come first; rows that repeat a doc_id
are all written.  Extra columns are not read.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from stillwater.llm import common, files, tokens

LIMIT, CHECKPOINT, BLOCK_IDS = 16, 512, 1 << 20
END = 0

_HEAD = struct.Struct("<4sIIQI")  # magic, documents, checkpoints, data bytes, packed index bytes
_MAGIC = b"HUF1"

CODED = "doc_id long, n_tokens long, bits binary, marks binary, part int"
DECODED = "doc_id long, start long, n_tokens long, ids binary"


def code_lengths(counts: np.ndarray, limit: int) -> np.ndarray:
    """Package-merge: optimal code lengths of at most ``limit`` bits; 0 for ids that never occur."""
    lengths = np.zeros(len(counts), np.uint8)
    used = np.flatnonzero(counts)
    n = len(used)
    if n > 1 << limit:
        raise ValueError(f"{n} ids need more than {limit} bits")
    if n < 3:
        lengths[used] = 1
        return lengths
    order = used[np.argsort(counts[used], kind="stable")]
    leaves = counts[order].astype(np.float64)
    levels, packages = [], np.zeros(0)
    for _ in range(limit):
        row = np.concatenate([leaves, packages])
        by = np.argsort(row, kind="stable")
        levels.append(by < n)
        row = row[by]
        packages = row[: len(row) // 2 * 2].reshape(-1, 2).sum(1)
    depth, take = np.zeros(n, np.int64), 2 * n - 2
    for is_leaf in reversed(levels):
        own = int(is_leaf[:take].sum())
        depth[:own] += 1
        take = 2 * (take - own)
    lengths[order] = depth
    return lengths


@dataclass
class Codes:
    lengths: np.ndarray  # by id
    codes: np.ndarray
    table: np.ndarray  # by the next ``bits`` bits: id * 32 + length
    bits: int

    @classmethod
    def of(cls, lengths: np.ndarray) -> Codes:
        bits = max(1, int(lengths.max(initial=0)))
        used = np.flatnonzero(lengths)
        used = used[np.lexsort((used, lengths[used]))]
        span = np.int64(1) << (bits - lengths[used].astype(np.int64))
        first = np.cumsum(span) - span
        codes = np.zeros(len(lengths), np.uint64)
        codes[used] = first >> (bits - lengths[used].astype(np.int64))
        table = np.zeros(1 << bits, np.uint32)
        filled = np.repeat(used * 32 + lengths[used], span)
        table[: len(filled)] = filled
        return cls(lengths, codes, table, bits)


def encode(codes: Codes, docs: list[np.ndarray]) -> list[tuple[bytes, np.ndarray]]:
    """Bits of each document, and the bit offsets of its checkpoints."""
    ids = np.concatenate(docs).astype(np.int64)
    sizes = np.array([len(d) for d in docs])
    starts = np.cumsum(sizes) - sizes
    length = codes.lengths[ids].astype(np.int64)
    total = np.concatenate([[0], np.cumsum(length)])
    own = total[starts + sizes] - total[starts]
    nbytes = (own + 7) // 8
    at = np.cumsum(nbytes) - nbytes
    inside = total[:-1] - np.repeat(total[starts], sizes)
    place = inside + np.repeat(at * 8, sizes)
    word = place >> 5
    value = codes.codes[ids] << (64 - (place & 31) - length).astype(np.uint64)
    out = np.zeros(int(nbytes.sum()) // 4 + 3, np.uint32)
    heads = np.flatnonzero(np.diff(word, prepend=-1))
    out[word[heads]] |= np.bitwise_or.reduceat((value >> np.uint64(32)).astype(np.uint32), heads)
    out[word[heads] + 1] |= np.bitwise_or.reduceat(value.astype(np.uint32), heads)
    raw = out.astype(">u4").tobytes()
    return [(raw[a : a + n], inside[s : s + k : CHECKPOINT].astype("<u4")) for a, n, s, k in zip(at.tolist(), nbytes.tolist(), starts.tolist(), sizes.tolist(), strict=True)]


def decode(codes: Codes, data: bytes, offsets: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """All ids of a block: ``counts`` ids from each bit offset on, one after another."""
    b = np.frombuffer(data + bytes(8), np.uint8).astype(np.uint32)
    windows = b[:-3] << np.uint32(24) | b[1:-2] << np.uint32(16) | b[2:-1] << np.uint32(8) | b[3:]
    out = np.zeros(int(counts.sum()), np.uint32)
    lanes = np.argsort(-counts, kind="stable")
    into, position, left = (np.cumsum(counts) - counts)[lanes], offsets[lanes].astype(np.int64), counts[lanes]
    shift = np.uint32(32 - codes.bits)
    active = len(lanes)
    for step in range(int(counts.max(initial=0))):
        while active and left[active - 1] <= step:
            active -= 1
        p = position[:active]
        found = codes.table[(windows[p >> 3] << (p & 7).astype(np.uint32)) >> shift]
        out[into[:active] + step] = found >> np.uint32(5)
        p += found & np.uint32(31)
    return out


class IdFiles(DataSource):
    """Format ``huffman_ids``: writes rows of ``CODED`` that come in order, reads rows of ``DECODED``."""

    @classmethod
    def name(cls) -> str:
        return "huffman_ids"

    def schema(self) -> str:
        return DECODED

    def reader(self, schema) -> DataSourceReader:
        return IdReader(self.options["path"])

    def writer(self, schema, overwrite) -> DataSourceArrowWriter:
        return IdWriter(self.options["path"])


@dataclass
class Written(WriterCommitMessage):
    partition: int
    name: str
    ids: int


class IdWriter(DataSourceArrowWriter):
    def __init__(self, path: str):
        self.path = path

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        number, total, name = TaskContext.get().partitionId(), 0, f"part-{uuid.uuid4().hex}.huf"
        system, path = files.locate(f"{self.path}/{name}")
        with system.open_output_stream(path, compression=None) as out:
            rows, size = [], 0
            for batch in iterator:
                for row in zip(*(c.to_pylist() for c in batch.columns[:4]), strict=True):
                    rows.append(row)
                    size += row[1]
                    if size >= BLOCK_IDS:
                        out.write(_block(rows))
                        rows, total, size = [], total + size, 0
            if rows:
                out.write(_block(rows))
        return Written(number, name, total + size)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        done = sorted((m for m in messages if m), key=lambda m: m.partition)
        before, listed = 0, []
        for m in done:
            listed.append([m.name, before])
            before += m.ids
        files.write(f"{self.path}/_files", json.dumps(listed).encode())

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        for m in messages:
            if m:
                files.delete(f"{self.path}/{m.name}")


def _block(rows: list[tuple]) -> bytes:
    data, marks, at = [], [], 0
    for _, _, bits, own in rows:
        marks.append(np.frombuffer(own, "<u4").astype(np.int64) + at * 8)
        data.append(bits)
        at += len(bits)
    offsets = np.concatenate(marks)
    index = zlib.compress(np.array([r[0] or 0 for r in rows], "<i8").tobytes() + np.array([r[0] is None for r in rows], "u1").tobytes() + np.array([r[1] for r in rows], "<u4").tobytes() + np.diff(offsets, prepend=0).astype("<u4").tobytes(), 1)
    return _HEAD.pack(_MAGIC, len(rows), len(offsets), at, len(index)) + index + b"".join(data)


class IdReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(tuple(x)) for x in json.loads(files.read(f"{self.path}/_files"))]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        name, start = partition.value
        codes = read_codes(self.path)
        system, path = files.locate(f"{self.path}/{name}")
        with system.open_input_stream(path, compression=None) as f:
            while head := f.read(_HEAD.size):
                magic, n, marks, size, packed = _HEAD.unpack(head)
                if magic != _MAGIC:
                    raise ValueError(f"{name} isn't a file of token ids")
                index = zlib.decompress(f.read(packed))
                doc_ids = np.frombuffer(index, "<i8", n)
                nulls = np.frombuffer(index, "u1", n, 8 * n).astype(bool)
                counts = np.frombuffer(index, "<u4", n, 9 * n).astype(np.int64)
                offsets = np.cumsum(np.frombuffer(index, "<u4", marks, 13 * n).astype(np.int64))
                per = (counts + CHECKPOINT - 1) // CHECKPOINT
                lane = np.full(marks, CHECKPOINT, np.int64)
                last = np.cumsum(per) - 1
                lane[last] = counts - (per - 1) * CHECKPOINT
                ids = decode(codes, f.read(size), offsets, lane).astype("<u4").tobytes()
                ends = np.cumsum(counts)
                for a in range(0, n, 1024):  # bounded Arrow batches
                    own = [ids[4 * (e - c) : 4 * e] for e, c in zip(ends[a : a + 1024].tolist(), counts[a : a + 1024].tolist(), strict=True)]
                    yield pa.RecordBatch.from_arrays([pa.array(doc_ids[a : a + 1024], pa.int64(), mask=nulls[a : a + 1024]), pa.array(start + (ends - counts)[a : a + 1024], pa.int64()), pa.array(counts[a : a + 1024], pa.int64()), pa.array(own, pa.binary())], names=["doc_id", "start", "n_tokens", "ids"])
                start += int(counts.sum())


def write_codes(path: str, lengths: np.ndarray) -> None:
    files.create_dir(path)
    files.write(f"{path}/_codes", zlib.compress(lengths.astype("u1").tobytes()))


def read_codes(path: str) -> Codes:
    return Codes.of(np.frombuffer(zlib.decompress(files.read(f"{path}/_codes")), np.uint8))


def tokenize(docs: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id, ids: little-endian ids of the whole text and the end id, two bytes each (four for a large vocabulary)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = tokens.encoder(vocabulary)
        end = np.array([END], own.kind).tobytes()
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x + end for x in own.encode(batch.column(1).to_pylist())], pa.binary())], names=["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), common.text_of().alias("text")).mapInArrow(run, "doc_id long, ids binary")


def global_counts(ids: DataFrame, size: int, kind: str) -> np.ndarray:
    """How often each id occurs; each task sends one row an id at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            total += np.bincount(np.frombuffer(b"".join(x or b"" for x in batch.column(0).to_pylist()), kind), minlength=size)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(total[some], pa.int64())], names=["id", "n"])

    out = np.zeros(size, np.int64)
    for row in ids.select("ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect():  # one row an id of the vocabulary
        out[row["id"]] = row["n"]
    return out


def write(docs: DataFrame, vocabulary: str, path: str, scratch: common.Scratch, limit: int = LIMIT) -> None:
    """Encode all documents into files of the folder ``path``, in ascending order of doc_id."""
    spark = docs.sparkSession
    own = tokens.encoder(vocabulary)
    size, kind = own.size, own.kind
    ids = scratch.table(tokenize(docs, vocabulary), "ids")
    lengths = code_lengths(global_counts(ids, size, kind), max(limit, size.bit_length()))
    write_codes(path, lengths)

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # places in the order of doc_id come from the doc_ids alone; a sample of whole rows would encode them twice
    bounds = np.unique(ids.approxQuantile("doc_id", [k / parts for k in range(1, parts)], 0.1 / parts)) if parts > 1 else np.zeros(0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = read_codes(path)
        for batch in batches:
            docs = [np.frombuffer(x, kind) for x in batch.column(1).to_pylist()]
            if docs:
                done = encode(codes, docs)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(d) for d in docs], pa.int64()), pa.array([d[0] for d in done], pa.binary()), pa.array([d[1].tobytes() for d in done], pa.binary()), pa.array(places(batch.column(0)), pa.int32())], names=["doc_id", "n_tokens", "bits", "marks", "part"])

    def places(doc_ids: pa.Array) -> np.ndarray:
        """Partition of each doc_id; null before all others."""
        known = doc_ids.fill_null(-(1 << 63)).to_numpy(zero_copy_only=False)
        return np.searchsorted(bounds, known.astype(np.float64), "right").astype(np.int32)

    coded = ids.mapInArrow(run, CODED)
    ordered = coded.repartitionById(parts, F.col("part")).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "n_tokens").drop("part")
    spark.dataSource.register(IdFiles)
    ordered.write.format("huffman_ids").option("path", path).mode("append").save()
    scratch.drop("ids")


def read(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids (little-endian, four bytes each)."""
    spark.dataSource.register(IdFiles)
    return spark.read.format("huffman_ids").option("path", path).load()


def round_trip(docs: DataFrame, vocabulary: str) -> DataFrame:
    """Write all documents and read the files back: doc_id, start, n_tokens, ids_crc32."""
    spark = common.prepare(docs.sparkSession)
    scratch = common.Scratch(spark, "huffman")
    write(docs, vocabulary, scratch.sub("files"), scratch)
    return read(spark, scratch.sub("files")).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
