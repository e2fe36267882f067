"""The jobs from archives to their outputs."""

import io
import json
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from fernlog.jobs import analyze, compare, sanitize
from fernlog.operators.inventory import Limits
from fernlog.sources import readers, store


def archive(files):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, data in files.items():
            z.writestr(name, data)
    return out.getvalue()


def request(status, ms, **more):
    return json.dumps({"log": {"entries": [{"startedDateTime": "2025-05-05T10:00:00Z", "time": ms, "request": {"method": "GET", "url": "https://shop.example/cart?id=7", **more}, "response": {"status": status}, "timings": {"wait": 9}}]}})


BAD_LOG = "\n".join(["2025-05-05T10:00:00Z INFO service=cart begin", "2025-05-05T10:00:01Z ERROR service=cart request_id=a1 connection refused to node=4411", "2025-05-05T10:00:02Z ERROR service=cart request_id=a2 connection refused to node=4412", "2025-05-05T10:00:03Z WARN service=cart call timed out"])
GOOD = {"conf/shop.env": "URL=mysql://u:p@db.example/x", "log/cart.log": "2025-05-05T09:00:00Z INFO fine\r\nsecond line", "net/x.har": request(200, 10), "readme.txt": "a shop"}
BAD = {"conf/shop.env": "URL=mysql://u:p@db.example/x", "log/cart.log": BAD_LOG, "net/x.har": request(503, 2100, headers=[{"name": "Cookie", "value": "k"}]), "readme.txt": "a broken shop"}
ODD = {"a.log": random.Random(1).randbytes(1 << 19).hex() + "\ntimed out", "b.har": "{", "in.zip": archive({"x": "y"}), "z.bin": "me@x.example\0", "z.txt": "you@x.example"}


@pytest.fixture(scope="module")
def workspace(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("bundles")
    for name, data in (("good.zip", archive(GOOD)), ("bad.zip", archive(BAD)), ("odd.zip", archive(ODD)), ("out.zip", archive({"ok.log": "x", "../up": "y"})), ("torn.zip", archive(GOOD)[:200])):
        (root / name).write_bytes(data)
    out = f"file://{root}/../ws-{root.name}"
    analyze.analyze_bundles(spark, f"file://{root}", out)
    return root, out, store.load_workspace(spark, out)


def test_counts_of_the_bundles(workspace):
    _, _, t = workspace
    count = lambda name, b: t[name].where(F.col("bundle_id") == b).count()
    assert [(count("findings", b), count("timeline", b), count("artifacts", b)) for b in ("good.zip", "bad.zip")] == [(0, 1, 4), (4, 4, 4)]
    assert {r.rule_id: r.occurrences for r in t["findings"].collect()} == {"LOG_CONNECTION_REFUSED": 2, "LOG_TIMEOUT": 1, "HAR_HTTP_5XX": 1, "HAR_SLOW_REQUESTS": 1}
    assert {(r.bundle_id, r.code) for r in t["rejected"].collect()} == {("out.zip", "path-traversal"), ("torn.zip", "artifact-malformed")}
    web = t["timeline"].where("source = 'har' AND bundle_id = 'bad.zip'").first()
    assert (web.severity, web.evidence.status, web.evidence.duration_ms, web.evidence.ttfb_ms) == ("error", 503, 2100.0, 9.0)
    assert web.message == "GET https://shop.example/cart returned 503 in 2100 ms"
    kinds = {(r.artifact, r.kind): r.matches for r in t["sensitive"].where("bundle_id = 'bad.zip'").collect()}
    assert kinds == {("conf/shop.env", "connection_string"): 1, ("conf/shop.env", "email"): 1, ("net/x.har", "cookie"): 1}


def test_warnings_and_runs(workspace, spark):
    _, out, t = workspace
    m = {r.bundle_id: r for r in t["manifest"].collect()}
    assert m["odd.zip"].warnings == ["nested archive in.zip was indexed but not extracted", "a.log: line is 1 MiB long or longer", "b.har: HAR file is malformed"]
    assert m["good.zip"].warnings == [] and len(m["good.zip"].input_sha256) == 64 and m["good.zip"].limits["findings"] == 10_000
    assert {r.bundle_id: r.status for r in t["runs"].collect()} == {"good.zip": "completed", "bad.zip": "completed", "odd.zip": "completed_with_warnings"}
    assert [(r.artifact, r.kind) for r in t["sensitive"].where("bundle_id = 'odd.zip'").collect()] == [("z.txt", "email")]
    with pytest.raises(ValueError, match="already exists"):
        store.write_workspace({"runs": t["runs"]}, out)


def test_caps_apply_to_the_union(spark):
    files = spark.createDataFrame([("b", n, bytearray(d.encode())) for n, d in BAD.items()], "bundle_id string, path string, content binary")
    t = analyze.analyze_artifacts(files, limits=Limits(findings=3, events=2))
    assert sorted(r.rule_id for r in t["findings"].collect()) == ["HAR_HTTP_5XX", "LOG_CONNECTION_REFUSED", "LOG_TIMEOUT"]
    m = t["manifest"].first()
    assert m.warnings == ["finding limit reached; additional findings were omitted", "timeline event limit reached; remaining events were not indexed"]


def test_comparison_of_stored_bundles(workspace, spark):
    t = workspace[2]
    pairs = spark.createDataFrame([("p", "good.zip", "bad.zip"), ("same", "bad.zip", "bad.zip")], "pair string, baseline string, incident string")
    got = compare.compare_bundles(t, pairs)
    rows = {k: sorted(map(tuple, v.collect()), key=repr) for k, v in got.items()}
    assert [r[:2] for r in rows["artifact_diff"]] == [("p", "log/cart.log"), ("p", "net/x.har"), ("p", "readme.txt")]
    assert len(rows["new_findings"]) == 4 and not rows["resolved_findings"] and len(rows["unchanged_rules"]) == 4
    assert ("p", "incident", "events", 4) in rows["counts"] and ("p", "baseline", "artifacts", 4) in rows["counts"]
    assert {(p, s): d for p, s, d in rows["severity_delta"] if p == "p"} == {("p", "high"): 2, ("p", "medium"): 2}


def test_sanitised_export(spark, tmp_path):
    rows = [("e", "a/x.txt", b"me@x.example wrote to you@x.example"), ("e", "b.txt", b"you@x.example pwd: 12345"), ("e", "c.bin", b"a\0b"), ("f", "a/x.txt", b"you@x.example")]
    files = spark.createDataFrame([(e, p, bytearray(c)) for e, p, c in rows], "export string, path string, content binary")
    out = f"file://{tmp_path}/export"
    sanitize.sanitize_export(files, out, "strict")
    got = {(r.export, r.path): r for r in spark.read.parquet(f"{out}/artifacts").collect()}
    assert got["e", "a/x.txt"].text == "EMAIL_001 wrote to EMAIL_002" and got["e", "b.txt"].text == "EMAIL_002 PASSWORD_001" and got["f", "a/x.txt"].text == "EMAIL_001"
    assert (got["e", "c.bin"].status, got["e", "c.bin"].text) == ("excluded", None) and "binary" in got["e", "c.bin"].reason
    manifest = {(r.export, r.path): r for r in spark.read.json(f"{out}/manifest").collect()}
    assert len(manifest) == 4 and all(len(r.source_sha256) == 64 for r in manifest.values())
    assert {(r.export, r.kind): r.replacements for r in spark.read.json(f"{out}/summary").collect()} == {("e", "email"): 3, ("e", "password"): 1, ("f", "email"): 1}
    with pytest.raises(ValueError, match="already exists"):
        sanitize.sanitize_export(files, out)
    with pytest.raises(ValueError, match="profile"):
        sanitize.sanitized(files, "loose")


def test_lines_of_artifacts(spark):
    data = b"".join(b"line %d\r\n" % k for k in range(3000)) + b"last\r"
    files = spark.createDataFrame([("b", "x", "0", bytearray(data)), ("b", "none", "1", None), ("b", "empty", "2", bytearray())], "bundle_id string, artifact string, sha256 string, content binary")
    got = readers.split_lines(files, batch_bytes=1000).collect()
    assert {r.line_no: r.line for r in got} == {k + 1: f"line {k}" for k in range(3000)} | {3001: "last"}
