"""Appends in two phases: a batch of rows is seen whole or not at all, and once however often it is written.

Each task writes a file of its own below ``data`` and reports its name.  The driver then writes one manifest with these names
below ``manifests``, under another name first, and moves it into place, which makes the batch visible.  Files of lost
attempts, of failed jobs and of a batch that was committed before stand in no manifest, so nobody reads them.  A batch that
overwrites names the batches that it replaces in its manifest, so old and new rows are exchanged by the same single move.

The driver holds one file name a task.  Of two drivers that commit one batch at once the last to move is seen.  Paths may be
local ones or URIs of stores that pyarrow knows; executors and driver must share them.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.pandas.types import to_arrow_schema


def _store(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def _manifests(store: fs.FileSystem, root: str) -> dict[str, dict]:
    """The manifests in place by batch, those that others replace left out."""
    found = store.get_file_info(fs.FileSelector(f"{root}/manifests", allow_not_found=True))
    held = {}
    for info in found:
        if info.base_name.endswith(".json"):
            with store.open_input_stream(info.path) as source:
                held[info.base_name[:-5]] = json.loads(source.read())
    gone = {name for m in held.values() for name in m["replaces"]}
    return {name: m for name, m in held.items() if name not in gone}


@dataclass
class Written(WriterCommitMessage):
    file: str


class CommittedWriter(DataSourceArrowWriter):
    def __init__(self, path: str, batch: str, schema: T.StructType, overwrite: bool):
        if not batch or not batch.replace("-", "").replace("_", "").isalnum():
            raise ValueError(f"a batch is named by letters, digits, - and _, not {batch!r}")
        self.path, self.batch, self.schema, self.overwrite = path, batch, schema, overwrite

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        store, root = _store(self.path)
        store.create_dir(f"{root}/data")
        file, schema = f"{root}/data/{self.batch}-{uuid.uuid4().hex}.parquet", to_arrow_schema(self.schema)
        with store.open_output_stream(file) as sink, pq.ParquetWriter(sink, schema, compression="zstd") as out:
            for batch in iterator:
                out.write_batch(batch.cast(schema))
        return Written(file)

    def commit(self, messages: list[Written | None]) -> None:
        store, root = _store(self.path)
        held = _manifests(store, root)
        place = f"{root}/manifests/{self.batch}.json"
        if store.get_file_info(place).type != fs.FileType.NotFound:
            self.abort(messages)  # committed before
            return
        store.create_dir(f"{root}/manifests")
        body = {"files": sorted(m.file for m in messages if m), "replaces": sorted(held) if self.overwrite else []}
        with store.open_output_stream(own := f"{root}/manifests/{uuid.uuid4().hex}.part") as sink:
            sink.write(json.dumps(body).encode())
        store.move(own, place)

    def abort(self, messages: list[Written | None]) -> None:
        store, _ = _store(self.path)
        for m in messages:
            if m and store.get_file_info(m.file).type != fs.FileType.NotFound:
                store.delete_file(m.file)


class CommittedSource(DataSource):
    """Options: path, and batch, the name of what is written."""

    @classmethod
    def name(cls) -> str:
        return "committed"

    def writer(self, schema: T.StructType, overwrite: bool) -> CommittedWriter:
        return CommittedWriter(self.options["path"], self.options.get("batch", ""), schema, overwrite)


def write(rows: DataFrame, path: str, batch: str, overwrite: bool = False) -> None:
    """Append rows as a batch, or put them in place of all batches seen; a batch that is there already stays as it is."""
    rows.sparkSession.dataSource.register(CommittedSource)
    rows.write.format("committed").option("batch", batch).mode("overwrite" if overwrite else "append").save(path)


def read(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The rows of all batches in place, by Spark's own Parquet reader."""
    store, root = _store(path)
    files = [f for m in _manifests(store, root).values() for f in m["files"]]
    if not files:
        return spark.createDataFrame([], schema)
    lead = path[: len(path) - len(root)] if path.endswith(root) else ""
    return spark.read.schema(schema).parquet(*(lead + f for f in files))
