"""Reading logs, HTTP archives, Windows events, analyzer output, artifacts and archives."""

from __future__ import annotations

import bz2
import gzip
import hashlib
import io
import lzma
import re
import tarfile
import zipfile
import zlib
from collections.abc import Iterator
from typing import BinaryIO
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fernlog.operators.inventory import Limits, clean_path
from fernlog.patterns import BAD_HAR, BAD_JSON, BAD_TYPE
from fernlog.storage import small, stored

HEADER = "struct<name string, value string>"
HAR_SCHEMA = f"""log struct<entries array<struct<startedDateTime string, time double,
 request struct<method string, url string, headers array<{HEADER}>, cookies array<{HEADER}>, postData struct<text string>>,
 response struct<status int, statusText string, headers array<{HEADER}>, cookies array<{HEADER}>, bodySize bigint, content struct<size bigint, mimeType string>>,
 timings struct<blocked double, dns double, connect double, ssl double, wait double>>>>"""
EVENT_SCHEMA = """System struct<Provider struct<_Name string>, EventID string, Level string, TimeCreated struct<_SystemTime string>, Channel string, Computer string>,
 EventData struct<Data array<string>>"""
#: Blocks of files whose first line numbers may be broadcast.
BROADCAST_BLOCKS = 1_000_000
#: Larger archives are opened where they lie instead of being a row.
ROW_BYTES = 64 << 20
EVIDENCE = "array<struct<artifact string, lineStart bigint, lineEnd bigint, jsonPointer string, timestamp string, excerpt string>>"
OUTPUT_SCHEMA = f"""type string,
 finding struct<id string, ruleId string, title string, severity string, category string, component string, summary string, explanation string, confidence string,
  evidence {EVIDENCE}, nextSteps array<string>, `references` array<string>, occurrences bigint>,
 event struct<timestamp string, source string, component string, severity string, category string, message string, artifact string, correlationId string, evidence string>,
 warning string"""


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of log files with 1-based numbers: artifact (file), line_no, line. Reads gzip by suffix.

    Lines end at a line feed; one carriage return before it is dropped. The files are read once: lines are stored in the shared
    folder with their block (a file's part that one task reads) and their place in the task's order, which hold from then on however
    files would be cut or packed another time. A line's number is its place in its block after the lines of the file's earlier
    blocks; these sums are a row a block, counted and broadcast, so that text isn't shuffled. Beyond BROADCAST_BLOCKS blocks the join is a
    shuffle.
    """
    raw = spark.read.option("lineSep", "\n").option("recursiveFileLookup", "true").text(path)
    rows = raw.select(F.col("_metadata.file_path").alias("artifact"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_id"), F.regexp_replace("value", r"\r$", "").alias("line"))
    return number_lines(stored(rows, "lines"))


def write_collected(lines: DataFrame, path: str) -> None:
    """Lines (bundle_id, artifact, line_no, line) as a log collector keeps them: few files, each line behind its bundle and artifact.

    The number of files follows the bytes, not the artifacts, which may be many and small. Lines are dealt out by range, so that a
    long artifact goes on in the next file. Lines hold no line feed; a null line is an empty one.
    """
    keys = ["bundle_id", "artifact", "line_no"]
    value = F.concat_ws("\t", F.to_json(F.struct("bundle_id", "artifact")), F.coalesce("line", F.lit("")))
    rows = lines.repartitionByRange(*keys).sortWithinPartitions(*keys).select(value.alias("value"))
    rows.write.option("lineSep", "\n").option("maxRecordsPerFile", 0).text(path)


def read_collected(spark: SparkSession, path: str) -> DataFrame:
    """``write_collected`` read again: bundle_id, artifact, line_no, line. Numbers come from the lines' places, as in ``read_lines``.

    An artifact's lines lie one after the other, in files in the order of their part numbers, so that a block of a file is a block of each of
    its artifacts.
    """
    raw = spark.read.option("lineSep", "\n").text(path)
    place = F.struct(F.regexp_extract(F.col("_metadata.file_name"), "part-([0-9]+)", 1).cast("long").alias("file"), F.col("_metadata.file_block_start").alias("start"))
    end = F.instr("value", "\t")
    line = F.regexp_replace(F.substr("value", end + 1), r"\r$", "")
    rows = raw.select(F.substr("value", F.lit(1), end - 1).alias("artifact"), place.alias("_block"), F.monotonically_increasing_id().alias("_id"), line.alias("line"))
    source = F.from_json("artifact", "bundle_id string, artifact string")
    return number_lines(stored(rows, "lines")).select(source.alias("s"), "line_no", "line").select("s.bundle_id", "s.artifact", "line_no", "line")


def number_lines(rows: DataFrame) -> DataFrame:
    """artifact, line_no, line of stored ``rows``: artifact, _block, _id (rising in a block, whose lines one task wrote), line."""
    blocks = rows.groupBy(F.col("artifact").alias("_a"), F.col("_block").alias("_b")).agg(F.min("_id").alias("_first"), F.count("*").alias("_n"))
    before = Window.partitionBy("_a").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    shift = F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first") + 1
    blocks = stored(blocks.select("_a", "_b", shift.alias("_shift")), "blocks")
    out = rows.join(small(blocks, BROADCAST_BLOCKS), (F.col("artifact") == F.col("_a")) & (F.col("_block") == F.col("_b")))
    return out.select("artifact", (F.col("_id") + F.col("_shift")).cast("long").alias("line_no"), "line")


def split_lines(artifacts: DataFrame, batch_bytes: int = 1 << 22) -> DataFrame:
    """Lines of ``artifacts`` (bundle_id, artifact, sha256, content): the first three with line_no and line.

    A task hands lines on in batches of about ``batch_bytes``, so that it holds one file and one batch.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for bundle, artifact, sha, content in zip(*batch.columns, strict=True):
                text, n = io.BytesIO(content.as_buffer() if content.is_valid else b""), 0
                while part := text.readlines(batch_bytes):
                    found = [x.removesuffix(b"\n").removesuffix(b"\r") for x in part]
                    numbers = pa.array(range(n + 1, n + len(part) + 1), pa.int64())
                    n += len(part)
                    yield pa.RecordBatch.from_arrays([*(pa.repeat(x, len(part)) for x in (bundle, artifact, sha)), numbers, pa.array(found, pa.binary())], ["bundle_id", "artifact", "sha256", "line_no", "line"])

    spec = "bundle_id string, artifact string, sha256 string, line_no bigint, line binary"
    out = artifacts.select("bundle_id", "artifact", "sha256", "content").mapInArrow(run, spec)
    return out.withColumn("line", F.col("line").cast("string"))


def har_entries(docs: DataFrame) -> DataFrame:
    """Requests of ``docs`` (any columns, and ``log``, the parsed archive) in the form that the operators take."""
    keys = [c for c in docs.columns if c != "log"]
    e = docs.select(*keys, F.posexplode("log.entries").alias("entry", "e"))
    none = F.array().cast(f"array<{HEADER}>")
    list_ = lambda c: F.coalesce(c, none)
    body = F.col("e.request.postData").isNotNull() | (F.size(list_("e.request.cookies")) > 0) | (F.size(list_("e.response.cookies")) > 0)
    return e.select(
        *keys, F.col("entry").cast("long").alias("entry"), F.col("e.startedDateTime").alias("started"), F.coalesce("e.time", F.lit(0.0)).alias("time_ms"),
        F.coalesce("e.request.method", F.lit("")).alias("method"), F.coalesce("e.request.url", F.lit("")).alias("url"), F.coalesce("e.response.status", F.lit(0)).alias("status"),
        F.coalesce("e.response.bodySize", F.lit(0)).alias("body_size"), F.coalesce("e.response.content.size", F.lit(0)).alias("content_size"),
        F.coalesce("e.timings.wait", F.lit(0.0)).alias("ttfb_ms"), F.concat(list_("e.request.headers"), list_("e.response.headers")).alias("headers"), body.alias("has_body"),
    )


def read_har(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Requests of HTTP archives in the form that the operators take, and the files that are no JSON."""
    schema = T._parse_datatype_string(HAR_SCHEMA + ", _bad string")
    docs = spark.read.schema(schema).option("multiLine", "true").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").json(path).select("*", F.col("_metadata.file_path").alias("artifact"))
    bad = docs.where("_bad IS NOT NULL AND log IS NULL").select("artifact", F.lit(BAD_HAR).alias("warning"))
    return har_entries(docs.where("_bad IS NULL").select("artifact", "log")), bad


def parse_har(artifacts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``read_har`` of artifacts (bundle_id, artifact, sha256, content) instead of files."""
    return _split_har(_parsed_har(artifacts))


def read_entries(artifacts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``parse_har``, stored: each archive is parsed once for both results."""
    parsed = stored(_parsed_har(artifacts), "entries")
    return _split_har(parsed)


def _parsed_har(artifacts: DataFrame) -> DataFrame:
    parsed = F.from_json(F.make_valid_utf8(F.col("content").cast("string")), HAR_SCHEMA + ", _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    docs = artifacts.select("bundle_id", "artifact", "sha256", parsed.alias("p"))
    return docs.select("bundle_id", "artifact", "sha256", F.coalesce(F.col("p._bad").isNotNull(), F.lit(True)).alias("broken"), F.col("p.log").alias("log"))


def _split_har(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    bad = docs.where("broken").select("bundle_id", "artifact", F.lit(BAD_HAR).alias("warning"))
    return har_entries(docs.where("NOT broken").select("bundle_id", "artifact", "sha256", "log")), bad


def read_windows_events(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Windows events of XML files, and the files that are refused because they declare a document type.

    Files are looked through line by line for a declaration. ``position`` is taken where the events are read.
    """
    text = spark.read.option("lineSep", "\n").text(path).where(F.col("value").rlike("(?i)<!DOCTYPE"))
    refused = text.select(F.col("_metadata.file_path").alias("artifact")).distinct().withColumn("warning", F.lit("document types are not allowed"))
    rows = spark.read.format("xml").option("rowTag", "Event").schema(EVENT_SCHEMA).load(path).select("*", F.col("_metadata.file_path").alias("artifact"))
    other = lambda c: F.coalesce(c, F.lit("unknown"))
    rows = rows.select(
        "artifact", F.monotonically_increasing_id().alias("position"), F.when(F.col("System.EventID").rlike("^[0-9]+$"), F.expr("try_cast(System.EventID AS INT)")).alias("event_id"),
        other("System.Provider._Name").alias("provider"), other("System.Channel").alias("channel"), other("System.Level").alias("level"),
        F.try_to_timestamp("System.TimeCreated._SystemTime").alias("ts"), other("System.Computer").alias("computer"), F.coalesce(F.array_join("EventData.Data", "; "), F.lit("")).alias("message"),
    )
    return rows.join(refused, "artifact", "left_anti"), refused


def read_analyzer_output(spark: SparkSession, path: str, most: int = 10_000) -> dict[str, DataFrame]:
    """JSON lines of analyzers' runs (files): findings (at most ``most`` of a run), events, warnings, and runs with their status.

    A line that is no JSON object and a record of unknown type give a warning; a run with warnings is completed_with_warnings.
    """
    rows = spark.read.option("lineSep", "\n").text(path).select(F.col("_metadata.file_path").alias("run"), F.monotonically_increasing_id().alias("at"), "value")
    parsed = rows.withColumn("r", F.from_json("value", OUTPUT_SCHEMA + ", _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}))
    null = F.trim("value") == "null"
    bad = ~null & (F.col("r._bad").isNotNull() | F.col("r").isNull() | ~F.trim("value").startswith("{"))
    parsed = parsed.select("run", "at", "r", bad.alias("bad"), F.coalesce(F.when(~bad, F.col("r.type")), F.lit("")).alias("type"))
    rank = F.row_number().over(Window.partitionBy("run").orderBy("at"))
    findings = parsed.where("type = 'finding' AND r.finding IS NOT NULL").withColumn("n", rank).where(F.col("n") <= most).select("run", "at", "r.finding.*")
    events = parsed.where("type = 'timeline_event' AND r.event IS NOT NULL").select("run", "at", "r.event.*")
    text = F.when(F.col("bad"), BAD_JSON).when(F.col("type") == "warning", F.coalesce("r.warning", F.lit(""))).otherwise(BAD_TYPE)
    warned = F.col("bad") | ~F.col("type").isin("finding", "timeline_event")
    status = F.when(F.max(warned), "completed_with_warnings").otherwise("completed")
    return {
        "findings": findings,
        "events": events,
        "warnings": parsed.where(warned).select("run", "at", text.alias("warning")),
        "runs": parsed.groupBy("run").agg(status.alias("status")),
    }


def read_artifacts(spark: SparkSession, path: str) -> DataFrame:
    """Files as bytes: path, size, content."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", F.col("length").alias("size"), "content")


def read_archives(spark: SparkSession, path: str, row_bytes: int = ROW_BYTES) -> DataFrame:
    """Archives: path, size, content. Content is null above ``row_bytes``: such a file is opened where it lies, as a stream."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    # the source looks at lengths before it reads, so that a large file is no row
    whole = files.where(F.col("length") <= row_bytes).select("path", F.col("length").alias("size"), "content")
    return whole.unionByName(files.where(F.col("length") > row_bytes).select("path", F.col("length").alias("size"), F.lit(None).cast("binary").alias("content")))


_ENTRY = [("bundle_id", pa.string()), ("entry_no", pa.int32()), ("name", pa.string()), ("path", pa.string()), ("size", pa.int64()), ("content", pa.binary()), ("code", pa.string()), ("warning", pa.string()), ("input_sha256", pa.string())]
#: Bytes of entries that a task hands on at once.
_HELD = 4 << 20


def _opened(path: str) -> BinaryIO:
    """A file as a stream with seeks, from any store that Arrow knows."""
    # Spark's paths are as people write them
    store, inner = fs.FileSystem.from_uri(quote(re.sub(r"^file:/+", "file:///", path), safe="/:@?=&"))
    return store.open_input_file(inner)


def _hashed(file: BinaryIO) -> str:
    digest = hashlib.sha256()
    while part := file.read(1 << 20):
        digest.update(part)
    file.seek(0)
    return digest.hexdigest()


def _members(name: str, file: BinaryIO) -> Iterator[tuple[str, str, int, BinaryIO | None]]:
    """(name, mode, compressed size or 0, stream) of an archive's entries, in its order."""
    low = name.lower()
    magic = file.read(4)
    file.seek(0)
    if magic == b"PK\x03\x04":
        with zipfile.ZipFile(file) as z:
            for i in z.infolist():
                kind = i.external_attr >> 16 & 0o170000
                mode = "directory" if i.is_dir() else "file" if kind in (0, 0o100000) else "symlink" if kind == 0o120000 else "other"
                yield i.filename, mode, i.compress_size, z.open(i) if mode == "file" else None
        return
    opened: BinaryIO = file
    if magic[:2] == b"\x1f\x8b":
        opened = gzip.GzipFile(fileobj=file)
        if not low.endswith((".tar.gz", ".tgz")):
            size = file.seek(0, 2) or file.tell()
            file.seek(0)
            yield low.rsplit("/", 1)[-1].removesuffix(".gz"), "file", size, opened
            return
    elif low.endswith((".tar.bz2", ".tbz2")):
        opened = bz2.BZ2File(file)
    elif low.endswith((".tar.xz", ".txz")):
        opened = lzma.LZMAFile(file)
    with tarfile.open(fileobj=opened, mode="r|") as t:
        for m in t:
            mode = "directory" if m.isdir() else "file" if m.isreg() else "symlink" if m.issym() else "other"
            yield m.name, mode, 0, t.extractfile(m) if m.isreg() else None


def _entries(path: str, file: BinaryIO, limits: Limits) -> Iterator[tuple]:
    """Rows of an archive up to its first bad entry, and its verdict as the last one.

    No more is inflated than the limits allow at that point: of an entry at most one byte above what the file, the rest of the
    total and the ratio leave.
    """
    files = total = n = 0
    seen: set[str] = set()
    code, warning = "ok", None
    digest = _hashed(file)
    try:
        for n, (name, mode, compressed, stream) in enumerate(_members(path, file), 1):
            if mode == "directory":
                continue
            own, verdict = clean_path(name, limits.name_bytes)
            if mode != "file":
                code = "unsafe-entry"
                break
            # the ratio is tested before the path, so that the bytes are needed first
            most = min([limits.file_bytes, limits.total_bytes - total, *([compressed * limits.ratio] if compressed else [])])
            content = stream.read(most + 1)
            size = len(content)
            if compressed and size > compressed * limits.ratio:
                code = "limit-exceeded"
            elif verdict != "ok":
                code = verdict
            elif own.lower() in seen:
                code = "unsafe-entry"
            elif files + 1 > limits.files or size > limits.file_bytes or total + size > limits.total_bytes:
                code = "limit-exceeded"
            if code != "ok":
                break
            seen.add(own.lower())
            files, total = files + 1, total + size
            yield path, n, name, own, size, content, None, None, None
    except (OSError, EOFError, ValueError, RuntimeError, zipfile.BadZipFile, tarfile.TarError, lzma.LZMAError, zlib.error) as e:
        code, warning = "artifact-malformed", f"archive is malformed: {type(e).__name__}"
    yield path, n, None, None, total, None, code, warning, digest


def expand_bundles(files: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """Entries of archives (path, content): bundle_id, entry_no, name, path (normalised), size, content; and for each archive a last
    row, without name and content, that holds its ``code``, a ``warning`` if it is broken, and the archive's ``input_sha256``.

    A task opens one archive at a time, as a stream where content is null, and hands entries on as they are read. The limits run
    along: the first entry that breaks one (or is unsafe) ends the archive with that code, so that an archive never gives more than
    ``limits.total_bytes``, whatever it would inflate to. Rows of an archive whose code isn't ``ok`` are to be left out. Archives inside archives
    stay closed.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(zip(*rows, strict=True), _ENTRY, strict=True)], [n for n, _ in _ENTRY])
        held: list[tuple] = []
        size = 0
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                try:
                    rows = _entries(path, io.BytesIO(content.as_py()) if content.is_valid else _opened(path), limits)
                except (OSError, ValueError, NotImplementedError) as e:
                    rows = iter([(path, 0, None, None, 0, None, "artifact-malformed", f"archive cannot be opened: {type(e).__name__}", None)])
                for row in rows:
                    if held and size + (row[4] or 0) > _HELD:
                        yield out(held)
                        held, size = [], 0
                    held.append(row)
                    size += len(row[5] or b"")
        if held:
            yield out(held)

    return files.select("path", "content").mapInArrow(run, "bundle_id string, entry_no int, name string, path string, size bigint, content binary, code string, warning string, input_sha256 string")
