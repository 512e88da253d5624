"""A streaming sink for alert documents that holds each exactly once.

Tasks hand their documents to a transport under a name of their own and report it. When all tasks
of an epoch are done, the driver writes one note that lists what they reported; a document counts
only if a note lists it. What a failed or repeated task left behind is in no note, and an epoch that
runs again finds its note and adds nothing. The transport here keeps files in any store that Arrow
reaches (local, HDFS, S3, GCS); another one needs the same four methods.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamWriter, WriterCommitMessage
from pyspark.sql.types import StructType

NOTES, PARTS = "notes", "parts"


class FileTransport:
    """Documents as JSON lines below a folder."""

    def __init__(self, folder: str):
        self.folder = folder.rstrip("/")

    def _store(self):
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(self.folder) if "://" in self.folder or self.folder.startswith("file:") else (
            fs.LocalFileSystem(), self.folder)
        return store, root

    def deliver(self, name: str, documents: Iterator[str]) -> int:
        """Keep documents under a name; how many there were. Nothing is kept of none."""
        store, root = self._store()
        lines = [d + "\n" for d in documents]  # the alerts of one task and epoch
        if lines:
            store.create_dir(f"{root}/{PARTS}", recursive=True)
            with store.open_output_stream(f"{root}/{PARTS}/{name}.json") as out:
                out.write("".join(lines).encode())
        return len(lines)

    def noted(self, epoch: int) -> bool:
        from pyarrow import fs

        store, root = self._store()
        return store.get_file_info(f"{root}/{NOTES}/{epoch}.json").type == fs.FileType.File

    def note(self, epoch: int, names: list[str]) -> None:
        """Make the documents under these names count, all at once."""
        store, root = self._store()
        store.create_dir(f"{root}/{NOTES}", recursive=True)
        half = f"{root}/{NOTES}/.{epoch}-{uuid.uuid4().hex}"
        with store.open_output_stream(half) as out:
            out.write(json.dumps({"epoch": epoch, "parts": names}).encode())
        store.move(half, f"{root}/{NOTES}/{epoch}.json")

    def drop(self, names: list[str]) -> None:
        """What an epoch that failed left behind may go; nothing lists it."""
        store, root = self._store()
        for name in names:
            store.delete_file(f"{root}/{PARTS}/{name}.json")


@dataclass
class Delivered(WriterCommitMessage):
    name: str
    documents: int


class _Writer(DataSourceStreamWriter):
    def __init__(self, transport: FileTransport):
        self.transport = transport

    def write(self, rows: Iterator[Row]) -> WriterCommitMessage:
        name = uuid.uuid4().hex
        return Delivered(name, self.transport.deliver(name, (r.payload for r in rows)))

    def commit(self, messages: list[WriterCommitMessage | None], batchId: int) -> None:
        names = [m.name for m in messages if m is not None and m.documents]
        if self.transport.noted(batchId):  # the epoch was complete before the query ended
            self.transport.drop(names)
        else:
            self.transport.note(batchId, names)

    def abort(self, messages: list[WriterCommitMessage | None], batchId: int) -> None:
        self.transport.drop([m.name for m in messages if m is not None and m.documents])


class AlertSink(DataSource):
    """``writeStream.format("alert_documents").option("path", folder)`` over (event_id, payload)."""

    @classmethod
    def name(cls) -> str:
        return "alert_documents"

    def streamWriter(self, schema: StructType, overwrite: bool) -> DataSourceStreamWriter:
        return _Writer(FileTransport(self.options["path"]))


def read_alerts(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """The alert documents that count, parsed."""
    notes = spark.read.schema("epoch bigint, parts array<string>").json(f"{folder}/{NOTES}")
    listed = notes.selectExpr("explode(parts) AS part")
    rows = spark.read.schema(schema).json(f"{folder}/{PARTS}")
    named = rows.selectExpr("*", "regexp_extract(_metadata.file_name, '^(.*)[.]json$', 1) AS part")
    return named.join(listed, "part", "left_semi").drop("part")
