"""Large text files in pieces that tasks read by byte range.

A file is cut where no pattern of the scan can reach across: behind a sentence end that an empty
line and a letter follow. Values and keywords around blanks, tokens, table rows and lines of
settings all end before such a place. Only connection strings may run on; they are looked for in
the outlines of a file's pieces put together (``outline``). Ranges are searched for their first cut
side by side; a piece lies between two cuts, and a stretch without one stays whole. Text is never
cut within a character.

A task scans its pieces in ``parts``, cut where a sentence ends a line of prose and another line of it
follows: most patterns run only over texts that hold what they need, so they are spared most parts.

Tasks read through Arrow's file systems (local, HDFS, S3, GCS); files in a store that only Spark
reaches are scanned whole (``payloads.read_files``).
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from textwarden.functions.regex import SPACE_CHARS
from textwarden.sources.tables import task_count
from textwarden.sources.workers import map_batches

RANGE_BYTES = 32 * 1024 * 1024
#: bytes before a cut that decide on it, and that must follow the last one
AROUND = 4096
_CUT = re.compile(rb"[a-z]{2}[.!?](?:\r?\n){2}(?=[A-Za-z])")
#: least bytes of a part
PART_BYTES = 2048
#: what ends a line before a part (three words, so no import statement) and begins the next one (no setting);
#: both are long enough for the narrative patterns, which pass over very short texts
_LINE_END = re.compile(rb"[!-~][ -~]{10,}[a-z] [a-z]+ [a-z]{2,}[.!?]\Z")
_LINE_START = re.compile(rb"[A-Z][a-z][ -~]{14,60}[!-~]")
#: least commas in a row of bulk data
_COMMAS = 3
#: characters that an outline keeps of a stretch without ``:``, ``@``, ``;`` and ``=``: behind its first blanks, before its last ones
HEAD, TAIL = 16, 24
_STRETCH = re.compile(rf"[^:@;=]{{{HEAD + TAIL + 2},}}")


def _opened(path: str):
    from pyarrow import fs

    if re.match(r"file:/|/", path):
        return fs.LocalFileSystem().open_input_file(re.sub(r"^file:/*", "/", path))
    store, inner = fs.FileSystem.from_uri(path)
    return store.open_input_file(inner)


def _bytes(path: str, start: int, end: int) -> bytes:
    with _opened(path) as file:
        file.seek(start)
        return file.read(end - start)


def list_files(spark: SparkSession, path: str, pattern: str | None = None) -> DataFrame:
    """(path, length) of the files below a folder; nothing is read."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    return reader.load(path).select("path", "length")


def _shortened(stretch: re.Match) -> str:
    text = stretch[0]
    head = len(text) - len(text.lstrip(SPACE_CHARS)) + HEAD
    middle = text[head:max(0, len(text.rstrip(SPACE_CHARS)) - TAIL)]
    if not middle:
        return text
    kept = next((mark for mark, kind in (("\n", "\n\r\u2028\u2029"), (" ", SPACE_CHARS), ('"', "\"'")) if any(c in middle for c in kind)), "x")
    return f"{text[:head]}{kept}{text[head + len(middle):]}"


def outline(text: str) -> str:
    """The text with long stretches shortened that hold nothing but what connection strings pass over.

    Their matches begin at a name right before ``:`` or ``=``, end soon behind one of ``:@=``, and in
    between only ``:``, ``@``, ``;``, ``=``, line ends, blanks and quotes decide. One character stands for the
    middle of a stretch: a line end if it holds one, else a blank, else a quote. So the outline has the same
    matches, and the outlines of neighbouring pieces together are an outline of both.
    """
    return _STRETCH.sub(_shortened, text)


def _facts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The first cut of each range but a file's first one."""
    for batch in batches:
        cuts = []
        for path, length, start, end in zip(*(c.to_pylist() for c in batch.columns)):
            low, high = max(0, start - AROUND), min(length, end + AROUND)
            found = (low + m.end() for m in _CUT.finditer(_bytes(path, low, high)))
            cuts.append(next((at for at in found if start <= at < end and start and length - at >= AROUND), None))
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(cuts, pa.int64())], ["path", "length", "start", "cut"])


def parts(piece: bytes, least: int) -> list[int]:
    """Where the parts of a piece start: line starts at least so many bytes apart that no pattern of the scan reaches across.

    Patterns that pass a line end need blanks, a keyword, a sign, a number or a field before it, or a setting
    behind it. Rows of bulk data follow each other line by line, so one of the two lines must have too few commas.
    """
    starts = [0]
    end = piece.find(b"\n", least)
    while 0 <= end and len(piece) - end > least:
        if _LINE_START.match(piece, end + 1) and _LINE_END.search(piece[max(0, end - 64):end]):
            before, behind = piece.rfind(b"\n", 0, end) + 1, piece.find(b"\n", end + 1)
            if piece.count(b",", before, end) < _COMMAS or piece.count(b",", end + 1, len(piece) if behind < 0 else behind) < _COMMAS:
                starts.append(end + 1)
                end += least
        end = piece.find(b"\n", end + 1)
    return starts


def read_tasks(files: DataFrame) -> int:
    """Tasks to read these files with; rows of paths and places are too small to tell."""
    return task_count(files.sparkSession, files.agg(F.sum("length")).first()[0] or 0)


def pieces(files: DataFrame, size: int = RANGE_BYTES, tasks: int | None = None) -> DataFrame:
    """(path, start, end) of the pieces of each file (path, length)."""
    starts = files.filter("length > 0").select("path", "length", F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(size).cast("long"))).alias("start"))
    ranges = starts.withColumn("end", F.least(F.col("start") + size, "length")).repartition(
        tasks or read_tasks(files), "path", "start")
    facts = map_batches(ranges, _facts, "path string, length long, start long, cut long")
    until = Window.partitionBy("path").orderBy("start")
    usable = facts.filter("start = 0 OR cut IS NOT NULL")
    return (usable.select("path", "length", F.coalesce("cut", "start").alias("start"))
            .withColumn("end", F.coalesce(F.lead("start").over(until), "length")).drop("length"))


def read_pieces(found: DataFrame, tasks: int) -> DataFrame:
    """The pieces in ``parts``, each with its start and ``text``; bytes that are not UTF-8 become replacement characters.

    The first part of a piece also carries the ``outline`` of the whole piece.
    """
    columns, least = found.columns, PART_BYTES

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                piece = _bytes(row["path"], row["start"], row["end"])
                starts = parts(piece, least)
                texts = [piece[a:b].decode("utf-8", "replace") for a, b in zip(starts, [*starts[1:], len(piece)])]
                held = {c: [row[c]] * len(starts) for c in columns}
                held |= {"start": [row["start"] + a for a in starts], "end": [row["start"] + b for b in [*starts[1:], len(piece)]]}
                outlines = [outline("".join(texts))] + [None] * (len(starts) - 1)
                yield pa.RecordBatch.from_arrays(
                    [*(pa.array(held[c], batch.schema.field(c).type) for c in columns), pa.array(texts, pa.string()), pa.array(outlines, pa.string())],
                    [*columns, "text", "outline"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in found.schema) + ", text string, outline string"
    return map_batches(found.repartition(tasks, "path", "start"), work, schema)
