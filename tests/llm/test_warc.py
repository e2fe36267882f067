import base64
import gzip
import hashlib
import time
import zlib

import pytest
from pyspark.sql import functions as F

from fernlog.llm import warc


def pages(spark):
    rows = [(3, "http://a/é x\r\nBad: 1", "hello"), (1, "u", "hello"), (2, None, "hello"), (4, "v", None), (5, "v", ""), (6, "w", "é" * 40_000 + "\r\n\r\nWARC/1.1\r\n"), (7, "w", "é" * 40_000 + "\r\n\r\nWARC/1.1\r\n"), (None, "n", "alone"), (8, "x", "0\r\n\r\n")]
    return spark.createDataFrame([(*r, 1) for r in rows], "page_id bigint, url string, html string, payload int").repartition(3)


def test_round_trip(spark):
    df = pages(spark)
    rows = df.collect()
    got = {r.page_id: r for r in warc.page_records(df).collect()}
    assert len(got) == len(rows) and all(r.status == "ok" for r in got.values())
    for r in rows:
        raw = (r.html or "").encode()
        same = [x.page_id for x in rows if x.page_id is not None and (x.html or "") == (r.html or "")]
        first = min(same) if same else None
        g = got[r.page_id]
        assert g.payload_bytes == len(raw)
        assert g.payload_digest == base64.b32encode(hashlib.sha1(raw).digest()).decode()
        assert (g.record_type, g.refers_to) == (("response", None) if r.page_id == first else ("revisit", first))


def test_payloads_come_back_from_segments(spark, tmp_path):
    df = pages(spark)
    path = f"file://{tmp_path}/archives"
    warc.write_archives(df, path, segment_bytes=700, chunk_bytes=300, records_per_file=5)
    found = warc.read_archives(spark, path).collect()
    texts = {r.page_id: bytes(r.payload).decode() for r in found if r.record_type == "response"}
    want = {r.page_id: r.html or "" for r in df.collect()}
    assert all(want[i] == t for i, t in texts.items()) and len(found) == len(want)
    assert {r.status for r in found} == {"ok"}
    all_own = f"file://{tmp_path}/own"
    warc.write_archives(df, all_own, revisit_from=10**9)
    assert {r.record_type for r in warc.read_archives(spark, all_own).collect()} == {"response"}
    with pytest.raises(Exception, match="(?i)exist"):
        warc.write_archives(df, path)


def members(data):
    """Each gzip member's content, one after the other."""
    while data:
        d = zlib.decompressobj(31)
        yield d.decompress(data)
        assert d.eof
        data = d.unused_data


def test_a_member_a_record_and_references_that_exist(spark, tmp_path):
    path = tmp_path / "archives"
    warc.write_archives(pages(spark), f"file://{path}", segment_bytes=700, records_per_file=4)
    names, refers, first = set(), set(), {}
    for part in path.glob("part-*"):
        for text in filter(None, members(part.read_bytes())):
            head = dict(x.split(": ", 1) for x in text[: text.index(b"\r\n\r\n")].decode().split("\r\n")[1:])
            assert text.startswith(b"WARC/1.1\r\n") and len(text) == text.index(b"\r\n\r\n") + 4 + int(head["Content-Length"]) + 4
            assert head["WARC-Record-ID"] not in names and not head["WARC-Date"].startswith("2024-01-01")
            names.add(head["WARC-Record-ID"])
            refers |= {head["WARC-Refers-To"]} if head["WARC-Type"] == "revisit" else set()
            first[head["WARC-Record-ID"]] = head["WARC-Type"]
    assert len(refers) == 3 and refers <= names and {first[r] for r in refers} == {"response"}


def test_many_digests_are_joined_by_a_salted_shuffle(spark, monkeypatch):
    df = pages(spark)
    want = sorted(map(tuple, warc.page_records(df).collect()), key=repr)
    monkeypatch.setattr(warc, "BROADCAST_DIGESTS", 0)
    assert sorted(map(tuple, warc.page_records(df).collect()), key=repr) == want


def test_damage_is_told(spark, tmp_path):
    head = "WARC/1.1\r\nWARC-Type: {t}\r\nWARC-Record-ID: <urn:page:{i}:0{n}>\r\n{more}Content-Length: {size}\r\n\r\n{block}\r\n\r\n"
    http = "HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n"

    def record(i, block, more="", t="response", n=""):
        return head.format(t=t, i=i, n=n, more=more, size=len(block), block=block)

    seg = "WARC-Segment-Number: {}\r\n"
    more = "WARC-Segment-Origin-ID: <urn:page:{}:0>\r\nWARC-Segment-Number: {}\r\n"
    body = http + "5\r\nhello\r\n0\r\n\r\n"
    data = (
        record(1, body)
        + record(2, http + "9\r\nhello\r\n0\r\n\r\n")
        + record(3, body, "WARC-Payload-Digest: sha1:AAAA\r\n")
        + record(4, body[:10], seg.format(1))
        + record(4, body[20:], more.format(4, 3) + f"WARC-Segment-Total-Length: {len(body)}\r\n", "continuation", ":3")
        + record(5, body[:10], seg.format(1))
        + record(5, body[10:], more.format(5, 2) + "WARC-Segment-Total-Length: 7\r\n", "continuation", ":2")
        + record(6, body[30:], more.format(6, 2) + f"WARC-Segment-Total-Length: {len(body)}\r\n", "continuation", ":2")
        + record(6, body[:30], seg.format(1))
    )
    (tmp_path / "x.warc").write_bytes(data.encode())
    got = {r.page_id: (r.status, r.payload and bytes(r.payload)) for r in warc.read_archives(spark, f"file://{tmp_path}/x.warc").collect()}
    assert got == {1: ("ok", b"hello"), 2: ("bad framing", None), 3: ("bad digest", b"hello"), 4: ("missing segment", None), 5: ("bad length", None), 6: ("ok", b"hello")}


def test_empty_and_repeated(spark):
    df = pages(spark)
    assert warc.page_records(df.where(F.lit(False))).count() == 0
    twice = warc.page_records(df.where("page_id in (1, 3)").union(df.where("page_id in (1, 3)"))).collect()
    assert sorted((r.page_id, r.record_type, r.payload_bytes) for r in twice) == [(1, "response", 5)] * 2 + [(3, "revisit", 5)] * 2


def test_members_are_inflated_in_step_with_the_file():
    """Many small members, a large one, empty ones and zeros at the end, as gzip reads them, in a time that doesn't grow with the square."""
    member = zlib.compress(b"x" * 200, 4, 31)
    odd = b"".join([member, zlib.compress(b"", 9, 31), zlib.compress(bytes(range(256)) * 4_000, 0, 31), member, bytes(9)])
    assert warc.inflate(odd) == gzip.decompress(odd) and warc.inflate(member[:-1] + member[-1:]) == b"x" * 200
    for bad in (odd[:100], member + b"junk", member[:-1]):
        with pytest.raises((EOFError, zlib.error)):
            warc.inflate(bad)
    assert warc.inflate(b"".join([member] * 3)) == b"x" * 600

    def seconds(n):
        start = time.process_time()
        assert len(warc.inflate(member * n)) == 200 * n
        return time.process_time() - start

    assert seconds(80_000) < 25 * max(seconds(8_000), 0.02)


def test_only_segments_are_shuffled(spark, tmp_path):
    """The look at the files for segments hands on no whole record, and that for whole ones no segment."""
    path = tmp_path / "archives"
    warc.write_archives(pages(spark), f"file://{path}", segment_bytes=700)
    files = spark.read.format("binaryFile").load(f"file://{path}").select("content")
    found = {s: files.mapInArrow(lambda b, s=s: warc._read(b, s), warc._READ).collect() for s in (True, False)}
    assert all(r.segment for r in found[True]) and not any(r.segment for r in found[False])
    assert len(found[True]) > 100 and {r.record_type for r in found[False]} == {"response", "revisit"}
