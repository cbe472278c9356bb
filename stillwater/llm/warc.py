"""WARC archives as a PySpark data source.

Writing: format ``warc`` takes rows of ``PAGES`` and writes one gzipped archive a task, a gzip member a record.  Each
member names its own length in a gzip extra field, so a reader can step over it.

Reading: the driver plans partitions of whole archives or, for large archives, of byte ranges; a range begins at the
first member that starts in it.  Predicates on record_type, record_id, page_id, target_uri, payload_digest and refers_to
are pushed down: a reader inflates no more than the headers of a record that they exclude, and with option
``payload=false`` no payload at all.  A payload that is read is checked against its digest.

Payloads that occur twice are stored once: the record with the smallest page_id is the response, the others revisit it.
Null html counts as an empty payload, null urls leave out the target, and records without page_id never get referred to
while their group has one with.  Rows that repeat a page_id are records of their own, each with its own record id.  Of rows
that repeat page_id and payload and would all be the response, the one with the smallest url is (nulls last; of rows that repeat
that too, any one), and the others revisit it.  Extra columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, In, InputPartition, WriterCommitMessage

from stillwater.llm import common, files

PAGES = "page_id long, record_id string, url string, payload binary, payload_bytes long, payload_sha1 string, refers_to long"
RECORDS = "record_type string, record_id string, page_id long, target_uri string, payload_digest string, payload_bytes long, refers_to long, payload binary"
RANGE_BYTES = 64 << 20

_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_DATE = "2020-01-01T00:00:00Z"
_FIXED = struct.Struct("<4sIBBHccHII")  # gzip header with one extra field "sl": inflated and whole length
_MAGIC = b"\x1f\x8b\x08\x04"
_HEADERS = ("record_type", "record_id", "page_id", "target_uri", "payload_digest", "refers_to")


def record_id(page_id: int | None, name: str) -> str:
    """The id of a record: its page and a name that no other record of the page has."""
    return f"<urn:page:{'none' if page_id is None else page_id}:{name}>"


def page_of(identifier: str) -> int | None:
    found = re.fullmatch(r"<urn:page:(-?\d+):[^>]*>", identifier)
    return int(found[1]) if found else None


def member(record: bytes) -> bytes:
    """One gzip member that tells its length."""
    deflate = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = deflate.compress(record) + deflate.flush()
    whole = _FIXED.size + len(body) + 8
    return _FIXED.pack(_MAGIC, 0, 0, 255, 12, b"s", b"l", 8, len(record) & 0xFFFFFFFF, whole) + body + struct.pack("<II", zlib.crc32(record), len(record) & 0xFFFFFFFF)


def record(page_id: int | None, identifier: str | None, url: str | None, payload: bytes, size: int, sha1: str, refers_to: int | None) -> bytes:
    """A response record, or a revisit record without payload; one without identifier gets a random name."""
    digest = base64.b32encode(bytes.fromhex(sha1)).decode()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {identifier or record_id(page_id, uuid.uuid4().hex)}", f"WARC-Date: {_DATE}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    lines += [f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response"]
    if refers_to is not None:
        lines += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: {record_id(refers_to, sha1)}"]
    lines.append(f"Content-Length: {len(block)}")
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


class Warc(DataSource):
    """Options: path (a folder), payload (false: no payloads), range_bytes."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return RECORDS

    def reader(self, schema) -> DataSourceReader:
        return WarcReader(self.options["path"], self.options.get("payload", "true").lower() != "false", int(self.options.get("range_bytes", RANGE_BYTES)))

    def writer(self, schema, overwrite) -> DataSourceArrowWriter:
        return WarcWriter(self.options["path"])


@dataclass
class Written(WriterCommitMessage):
    name: str


class WarcWriter(DataSourceArrowWriter):
    """An archive a task under a name of its own; a commit renames what counts, so lost attempts are never read."""

    def __init__(self, path: str):
        self.path = path

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        name = f"pages-{uuid.uuid4().hex}.warc.gz"
        system, path = files.locate(f"{self.path}/{name}.part")
        system.create_dir(path.rsplit("/", 1)[0], recursive=True)
        with system.open_output_stream(path, compression=None) as out:
            out.write(member(f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:{uuid.uuid4()}>\r\nWARC-Date: {_DATE}\r\nContent-Type: application/warc-fields\r\nContent-Length: 18\r\n\r\nformat: WARC/1.1\r\n\r\n\r\n".encode()))
            for batch in iterator:
                for row in zip(*(batch.column(c).to_pylist() for c in ("page_id", "record_id", "url", "payload", "payload_bytes", "payload_sha1", "refers_to")), strict=True):
                    out.write(member(record(*row)))
        return Written(name)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        for m in messages:
            if m:
                system, path = files.locate(f"{self.path}/{m.name}")
                system.move(f"{path}.part", path)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        for m in messages:
            if m:
                files.delete(f"{self.path}/{m.name}.part")


def _wanted(fields: dict, tests: list[tuple[str, tuple]]) -> bool:
    return all(fields[name] in values for name, values in tests)


class WarcReader(DataSourceReader):
    def __init__(self, path: str, payload: bool, range_bytes: int):
        self.path, self.payload, self.range_bytes, self.tests = path, payload, range_bytes, []

    def pushFilters(self, filters):
        """Keep equality and IN tests on header fields; Spark applies all others."""
        for f in filters:
            if isinstance(f, (EqualTo, In)) and len(f.attribute) == 1 and f.attribute[0] in _HEADERS:
                self.tests.append((f.attribute[0], (f.value,) if isinstance(f, EqualTo) else tuple(f.value)))
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        return [InputPartition((name, a, min(a + self.range_bytes, size))) for name, size in files.sizes(self.path, ".warc.gz") for a in range(0, size, self.range_bytes)]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        name, at, end = partition.value
        system, path = files.locate(f"{self.path}/{name}")
        rows, held = [], 0
        with system.open_input_file(path) as f:
            size = f.size()
            at = self._first(f, at, size)
            while at < end:
                f.seek(at)
                head = f.read(_FIXED.size)
                magic, *_, whole = _FIXED.unpack(head)
                if magic != _MAGIC:
                    raise ValueError(f"{name} has no record at byte {at}")
                row = self._record(f.read(whole - _FIXED.size))
                at += whole
                if row:
                    rows.append(row)
                    held += len(row[-1] or b"") + 200
                    if held > 4 << 20:
                        yield _batch(rows)
                        rows, held = [], 0
        if rows:
            yield _batch(rows)

    def _first(self, f, at: int, size: int) -> int:
        """The first member that starts at ``at`` or later: one whose successor is a member too, or the file's end."""
        while at < size and at:
            f.seek(at)
            window = f.read(1 << 20)
            k = window.find(_MAGIC)
            while k >= 0:
                f.seek(at + k)
                head = f.read(_FIXED.size)
                if len(head) == _FIXED.size and head[12:16] == b"sl\x08\x00":
                    after = at + k + _FIXED.unpack(head)[-1]
                    f.seek(min(after, size))
                    if after == size or f.read(4) == _MAGIC:
                        return at + k
                k = window.find(_MAGIC, k + 1)
            at += max(1, len(window) - 3) if len(window) > 3 else size
        return at

    def _record(self, body: bytes) -> tuple | None:
        inflate = zlib.decompressobj(-15)
        text, rest = inflate.decompress(body, 2048), b""
        while (cut := text.find(b"\r\n\r\n")) < 0 and inflate.unconsumed_tail:
            text += inflate.decompress(inflate.unconsumed_tail, 2048)
        lines = dict(x.split(": ", 1) for x in text[:cut].decode().split("\r\n")[1:])
        kind = lines["WARC-Type"]
        fields = {"record_type": kind, "record_id": lines["WARC-Record-ID"], "page_id": page_of(lines["WARC-Record-ID"]), "target_uri": lines.get("WARC-Target-URI"), "payload_digest": lines.get("WARC-Payload-Digest", "").removeprefix("sha1:") or None, "refers_to": page_of(lines.get("WARC-Refers-To", ""))}
        if not _wanted(fields, self.tests):
            return None
        payload_bytes = payload = None
        if kind in ("response", "revisit"):
            while (http := text.find(b"\r\n\r\n", cut + 4)) < 0 and inflate.unconsumed_tail:
                text += inflate.decompress(inflate.unconsumed_tail, 2048)
            payload_bytes = int(re.search(rb"\r\nContent-Length: (\d+)", text[cut + 4 : http])[1])
            if self.payload and kind == "response":
                rest = text + inflate.decompress(inflate.unconsumed_tail)
                payload = rest[http + 4 : http + 4 + payload_bytes]
                if len(payload) != payload_bytes or base64.b32encode(hashlib.sha1(payload).digest()).decode() != fields["payload_digest"]:
                    raise ValueError(f"{fields['record_id']} doesn't have the payload of its digest")
        return kind, fields["record_id"], fields["page_id"], fields["target_uri"], fields["payload_digest"], payload_bytes, fields["refers_to"], payload


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.binary()]
    names = [x.split()[0] for x in RECORDS.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


def write_pages(pages: DataFrame, path: str, least_bytes: int = 0) -> None:
    """Write a record a row of pages (page_id, url, html); equal payloads of ``least_bytes`` or more are stored once."""
    spark = common.prepare(pages.sparkSession)
    spark.dataSource.register(Warc)
    files.create_dir(path)
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.encode(common.text_of("html"), "UTF-8").alias("payload"))
    rows = rows.withColumns({"payload_bytes": F.octet_length("payload").cast("long"), "payload_sha1": F.sha1("payload")})
    big = F.col("payload_bytes") >= least_bytes
    # groups of two or more, by digest alone: no payload moves for them; tied: rows that the smallest page_id has in the group
    each = rows.where(big).groupBy("payload_sha1", "page_id").agg(F.count("*").alias("m"))
    groups = each.groupBy("payload_sha1").agg(F.min("page_id").alias("first"), F.min_by("m", "page_id").alias("tied"), F.sum("m").alias("n"))
    scratch = common.Scratch(spark, "warc-groups")
    groups = scratch.table(groups.where("n > 1 and first is not null"), "groups")
    joined = common.attach(rows, groups, "payload_sha1", "n", rows.select("page_id").count(), ["first", "tied"], spread=["page_id", "url"])
    out = joined.withColumn("refers_to", F.when(big & ~F.col("page_id").eqNullSafe(F.col("first")), F.col("first")))
    if not groups.where("tied > 1").isEmpty():
        tied = F.coalesce(big & (F.col("page_id") == F.col("first")) & (F.col("tied") > 1), F.lit(False))
        leads = scratch.table(out.where(tied).withColumn("at", F.monotonically_increasing_id()), "tied")
        best = leads.groupBy("payload_sha1").agg(F.min(F.struct(F.col("url").isNull().alias("a"), F.col("url").alias("b"), F.col("at").alias("c"))).alias("best"), F.count("*").alias("n"))
        best = scratch.table(best.select("payload_sha1", F.col("best.c").alias("lead"), F.col("n").alias("rows")), "best")
        settled = common.heavy_light_join(leads, best, ["payload_sha1"], "rows", leads.count())
        settled = settled.withColumn("refers_to", F.when(F.col("at") != F.col("lead"), F.col("first")))
        out = out.where(~tied).unionByName(settled.select(out.columns))
    out = out.withColumn("payload", F.when(F.col("refers_to").isNull(), F.col("payload")).otherwise(F.lit(b"")))
    # a response that others may refer to is the only one of its page and payload
    named = F.concat(F.lit("<urn:page:"), F.col("page_id").cast("string"), F.lit(":"), "payload_sha1", F.lit(">"))
    out = out.withColumn("record_id", F.when(big & F.col("refers_to").isNull(), named))
    out.select("page_id", "record_id", "url", "payload", "payload_bytes", "payload_sha1", "refers_to").write.format("warc").option("path", path).mode("append").save()


def read(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """The records of a folder of archives."""
    common.prepare(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Warc)
    return spark.read.format("warc").option("path", path).option("payload", str(payload).lower()).load()


def round_trip(pages: DataFrame) -> DataFrame:
    """Write all pages and read the archives back: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    spark = pages.sparkSession
    path = common.Scratch(common.prepare(spark), "warc").sub("archives")
    write_pages(pages, path)
    found = read(spark, path).where(F.col("record_type").isin("response", "revisit"))
    size = F.when(F.col("record_type") == "response", F.octet_length("payload").cast("long")).otherwise(F.col("payload_bytes"))
    return found.select("page_id", size.alias("payload_bytes"), "payload_digest", "record_type", "refers_to")
