"""WARC archives: writing records with revisits and segments, and reading them back whole."""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator
from datetime import UTC, datetime

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fernlog.llm.common import discard, remove, scratch, stored

#: Ends each record, inside its gzip member.
END = b"\r\n\r\n"
#: A gzip member of nothing: the text writer puts it after every row, so that a part file is a sequence of members.
NOTHING = zlib.compress(b"", 9, 31).decode("latin-1")
#: Payloads that occur more than once which may be broadcast; beyond that the join is a shuffle with so many salts.
BROADCAST_DIGESTS, SALTS = 300_000, 16
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
_READ = "page_id bigint, record_type string, name string, refers string, origin string, segment int, total bigint, block binary, digest string, payload binary, status string"


def digest32(col: Column) -> Column:
    """Bare upper-case base32 SHA-1 of a binary column, from built-in functions: 20 bits give four characters."""
    alphabet, hexed = F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"), F.sha1(col)
    out = []
    for i in range(8):
        n = F.conv(F.substring(hexed, 1 + 5 * i, 5), 16, 10).cast("int")
        out += [F.substr(alphabet, F.shiftright(n, s).bitwiseAND(F.lit(31)) + 1, F.lit(1)) for s in (15, 10, 5, 0)]
    return F.concat(*out)


def _chunked(payload: bytes, size: int) -> bytes:
    parts = [b"%x\r\n%b\r\n" % (len(p), p) for i in range(0, len(payload), size) if (p := payload[i : i + size])]
    return b"".join([*parts, b"0\r\n\r\n"])


def dechunk(body: bytes) -> bytes:
    """The payload of a chunked body; ValueError if its framing is broken."""
    out, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        if end < 0:
            raise ValueError("no chunk size")
        n = int(body[at:end].split(b";")[0], 16)
        at = end + 2
        if n == 0:
            return b"".join(out)
        if n < 0 or body[at + n : at + n + 2] != b"\r\n":
            raise ValueError("chunk cut short")
        out.append(body[at : at + n])
        at += n + 2


def _record(kind: str, name: str, date: str, fields: dict[str, str], block: bytes) -> bytes:
    """The record as a gzip member of its own."""
    head = {"WARC-Type": kind, "WARC-Record-ID": f"<{name}>", "WARC-Date": date, **fields, "Content-Length": str(len(block))}
    return zlib.compress(b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items()).encode() + b"\r\n" + block + END, 4, 31)


def _records(batches: Iterator[pa.RecordBatch], segment_bytes: int, chunk_bytes: int, date: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for page, row, url, payload, digest, first, of_first in zip(*(batch.column(i).to_pylist() for i in range(7)), strict=True):
            name = f"urn:page:{page}:{row}"
            fields = {"WARC-Payload-Digest": f"sha1:{digest}"}
            if url:
                fields["WARC-Target-URI"] = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)
            if of_first is not None:
                profile = {"WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", "WARC-Refers-To": f"<urn:page:{first}:{of_first}>"}
                out.append(_record("revisit", name, date, fields | profile, _HTTP))
                continue
            block = _HTTP + _chunked(payload, chunk_bytes)
            parts = [block[i : i + segment_bytes] for i in range(0, len(block), segment_bytes)]
            kind = fields | {"Content-Type": "application/http; msgtype=response"}
            if len(parts) == 1:
                out.append(_record("response", name, date, kind, block))
                continue
            out.append(_record("response", name, date, kind | {"WARC-Segment-Number": "1"}, parts[0]))
            for n, part in enumerate(parts[1:], 2):
                more = {"WARC-Segment-Origin-ID": f"<{name}>", "WARC-Segment-Number": str(n)}
                if n == len(parts):
                    more["WARC-Segment-Total-Length"] = str(len(block))
                out.append(_record("continuation", f"{name}:{n}", date, more, part))
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["record"])


def write_archives(pages: DataFrame, path: str, segment_bytes: int = 16_384, chunk_bytes: int = 4_096, records_per_file: int = 2_000, revisit_from: int = 0) -> None:
    """Write one WARC record for each page, or a record and its continuations if it is longer than a segment.

    ``pages`` has page_id, url, html; other columns are ignored. Of pages with equal payloads of at least
    ``revisit_from`` bytes the one of smallest page_id is a response and the others are revisits that name its record.
    Payloads equal by SHA-1 count as equal. The archives are part files of at most ``records_per_file`` records, each record
    a gzip member of its own. The pages are stored with numbers of their own, from which the identifiers come, and from then on
    payloads stay where they are: only the digests that occur more than once are gathered and, up to
    BROADCAST_DIGESTS of them, broadcast; more are joined by a shuffle in which SALTS tasks share a digest.

    A null html is an empty payload, a null url leaves out the target URI, a null page_id comes after all others (and
    revisits nothing smaller than itself if it is alone). Repeated rows of the smallest page_id are all responses.
    """
    raw = pages.select("page_id", "url", F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("payload"), F.monotonically_increasing_id().alias("row"))
    base = stored(raw.withColumn("digest", digest32(F.col("payload"))), "payloads")
    rank = F.struct(F.col("page_id").isNull().alias("none"), F.col("page_id").alias("page"), F.col("row").alias("row"))
    same = base.groupBy(F.col("digest").alias("_digest")).agg(F.count("*").alias("n"), F.min(rank).alias("first")).where("n > 1").select("_digest", "first")
    same = stored(same, "same")
    if same.count() <= BROADCAST_DIGESTS:
        joined = base.join(F.broadcast(same), F.col("digest") == F.col("_digest"), "left")
    else:
        salted = same.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = base.join(salted, (F.col("digest") == F.col("_digest")) & (F.pmod(F.xxhash64("row"), F.lit(SALTS)) == F.col("_salt")), "left")
    response = F.col("first").isNull() | F.col("page_id").eqNullSafe(F.col("first.page")) | (F.octet_length("payload") < revisit_from)
    rows = joined.select("page_id", "row", "url", F.when(response, F.col("payload")).alias("payload"), "digest", F.col("first.page").alias("first"), F.when(~response, F.col("first.row")).alias("of_first"))
    date = datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    records = rows.mapInArrow(lambda b: _records(b, segment_bytes, chunk_bytes, date), "record binary")
    writer = records.select(F.col("record").cast("string").alias("value")).write.mode("errorifexists")
    writer.option("encoding", "ISO-8859-1").option("lineSep", NOTHING).option("maxRecordsPerFile", records_per_file).text(path)
    discard(base, same)


def inflate(data: bytes, step: int = 1 << 13) -> bytes:
    """The content of all gzip members of ``data``; zero bytes may fill its end.

    It is fed in steps, so that what follows a member is copied once a step and not once for each member before it.
    """
    at, out, size = 0, [], len(data)
    view, member = memoryview(data), zlib.decompressobj(31)
    while at < size:
        part = view[at : at + step]
        out.append(member.decompress(part))
        at += len(part)
        if member.eof:
            at -= len(member.unused_data)
            while at < size and not view[at]:
                at += 1
            if at == size:
                return b"".join(out)
            member = zlib.decompressobj(31)
    raise EOFError("the archive ends inside a gzip member")


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields (lower-case names) and block of each record of an archive, by the declared lengths."""
    at, size = 0, len(data)
    while at < size:
        end = data.find(b"\r\n\r\n", at)
        lines = data[at:end].decode("utf-8", "replace").split("\r\n")
        if end < 0 or not lines[0].startswith("WARC/"):
            raise ValueError(f"no record at byte {at}")
        head = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        start = end + 4
        stop = start + int(head["content-length"])
        if data[stop : stop + 4] != b"\r\n\r\n":
            raise ValueError(f"record at byte {at} is cut short")
        yield head, data[start:stop]
        at = stop + 4


def unpack(block: bytes, digest: str | None) -> tuple[bytes | None, str]:
    """Payload of an HTTP response block, and what was found: ok, bad digest or bad framing."""
    head, _, body = block.partition(b"\r\n\r\n")
    try:
        payload = dechunk(body) if re.search(rb"(?i)\r\ntransfer-encoding:\s*chunked", head) else body
    except ValueError:
        return None, "bad framing"
    own = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    return payload, "ok" if digest in (None, own) else "bad digest"


def _number(urn: str | None) -> int | None:
    m = re.match(r"<urn:page:(-?\d+)", urn or "")
    return int(m[1]) if m else None


def _read(batches: Iterator[pa.RecordBatch], segments: bool) -> Iterator[pa.RecordBatch]:
    """The segments of records, or the records that are whole."""
    names = [x.split()[0] for x in _READ.split(", ")]
    kinds = {"page_id": pa.int64(), "segment": pa.int32(), "total": pa.int64(), "block": pa.binary(), "payload": pa.binary()}
    for batch in batches:
        for content in batch.column(0):
            data = content.as_py()
            rows = []
            for head, block in parse(inflate(data) if data[:2] == b"\x1f\x8b" else data):
                if segments != (head["warc-type"] != "revisit" and "warc-segment-number" in head):
                    continue
                name, digest = head["warc-record-id"], head.get("warc-payload-digest", "").removeprefix("sha1:") or None
                row = dict.fromkeys(names) | {"page_id": _number(name), "record_type": head["warc-type"], "name": name, "digest": digest, "status": "ok"}
                if head["warc-type"] == "revisit":
                    row["refers"] = head.get("warc-refers-to")
                elif segments:
                    total = head.get("warc-segment-total-length")
                    row |= {"origin": head.get("warc-segment-origin-id", name), "segment": int(head["warc-segment-number"]), "total": int(total) if total else None, "block": block}
                else:
                    row["payload"], row["status"] = unpack(block, digest)
                rows.append(row)
                if len(rows) == 500:
                    yield _batch(rows, names, kinds)
                    rows = []
            yield _batch(rows, names, kinds)


def _batch(rows: list[dict], names: list[str], kinds: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kinds.get(k, pa.string())) for k in names], names)


def _assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        payloads, states, digests = [], [], []
        for digest, total, numbers, blocks in zip(*(batch.column(i).to_pylist() for i in range(1, 5)), strict=True):
            block = b"".join(blocks)
            payload, state = None, "ok"
            if numbers != list(range(1, len(numbers) + 1)) or total is None:
                state = "missing segment"
            elif total != len(block):
                state = "bad length"
            else:
                payload, state = unpack(block, digest)
            payloads.append(payload)
            states.append(state)
            digests.append(digest)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(digests, pa.string()), pa.array(payloads, pa.binary()), pa.array(states, pa.string()), batch.column(5)], ["page_id", "digest", "payload", "status", "name"])


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """The records of all archives in a folder: page_id, record_type, name, refers, digest (declared), payload, status.

    ``name`` is the record's identifier and ``refers`` that of the record that a revisit names. Segments are brought together by
    the record that they come from, put in order, and held against the declared total
    length; then the chunked framing is removed. status is ok, missing segment, bad length, bad framing or bad digest;
    in all but the first and the last the payload is null. Revisits have no payload of their own. A file that isn't a
    sequence of records fails the read. An empty folder of archives gives no rows.
    """
    files = spark.read.format("binaryFile").load(path).select("content")
    # the whole records are unpacked and passed on where they are; only segments are shuffled, by a look at the files that gives nothing else
    parts = files.mapInArrow(lambda b: _read(b, True), _READ).groupBy("origin").agg(
        F.max(F.when(F.col("segment") == 1, F.col("page_id"))).alias("page_id"),
        F.max("digest").alias("digest"),
        F.max("total").alias("total"),
        F.sort_array(F.collect_list(F.struct("segment", "block"))).alias("parts"),
    )
    parts = parts.select("page_id", "digest", "total", F.col("parts.segment").alias("numbers"), F.col("parts.block").alias("blocks"), "origin")
    whole = parts.mapInArrow(_assemble, "page_id bigint, digest string, payload binary, status string, name string")
    columns = ["page_id", "record_type", "name", "refers", "digest", "payload", "status"]
    whole = whole.withColumns({"record_type": F.lit("response"), "refers": F.lit(None).cast("string")})
    found = files.mapInArrow(lambda b: _read(b, False), _READ)
    return found.select(columns).unionByName(whole.select(columns))


def page_records(pages: DataFrame) -> DataFrame:
    """Pages written to archives in the shared folder and read back: page_id, payload_bytes, payload_digest, record_type, refers_to, status.

    A revisit is resolved by the record identifier that it names: size and digest are those of that response, whose digest must
    be the declared one, and refers_to is its page_id.
    """
    spark = pages.sparkSession
    path = scratch(spark, "warc")
    write_archives(pages, path)
    own = F.when(F.col("record_type") == "response", digest32(F.col("payload")))
    read = read_archives(spark, path).select("page_id", "record_type", "name", "refers", "digest", F.octet_length("payload").cast("long").alias("payload_bytes"), own.alias("own"), "status")
    read = stored(read, "records")
    remove(spark, path)
    responses, revisits = read.where("record_type = 'response'"), read.where("record_type = 'revisit'").drop("payload_bytes")
    # the names that revisits refer to are as few as the repeated payloads: one row each meets the responses
    named = revisits.select(F.col("refers").alias("_name")).distinct()
    firsts = stored(responses.join(named, F.col("name") == F.col("_name")).select("_name", F.col("page_id").alias("id"), F.col("own").alias("sha"), F.col("payload_bytes").alias("n")), "responses")
    firsts = F.broadcast(firsts) if firsts.count() <= BROADCAST_DIGESTS else firsts
    resolved = revisits.join(firsts, (F.col("refers") == F.col("_name")) & (F.col("digest") == F.col("sha")), "left")
    status = F.when(F.col("sha").isNull(), F.lit("no response")).otherwise(F.col("status"))
    resolved = resolved.select("page_id", F.col("n").alias("payload_bytes"), F.col("sha").alias("payload_digest"), "record_type", F.col("id").alias("refers_to"), status.alias("status"))
    own = responses.select("page_id", "payload_bytes", F.col("own").alias("payload_digest"), "record_type", F.lit(None).cast("long").alias("refers_to"), "status")
    return own.unionByName(resolved)


def _oracle() -> str:
    char = "substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (CAST('0x' || substr(h, {i}, 5) AS BIGINT) >> {s}) % 32 + 1, 1)"
    base32 = " || ".join(char.format(i=1 + 5 * i, s=s) for i in range(8) for s in (15, 10, 5, 0))
    return f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY h) AS first FROM p)
SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, {base32} AS payload_digest,
       CASE WHEN page_id IS NOT DISTINCT FROM first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id IS NOT DISTINCT FROM first THEN NULL ELSE first END AS refers_to, 'ok' AS status
FROM f"""


ORACLE = _oracle()
