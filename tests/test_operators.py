import base64
import json
from datetime import datetime

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from fernlog.jobs.analyze import analyze
from fernlog.operators import audit, compare, har, inventory, logs, platform_rules, query, sanitize
from fernlog.operators.registry import Registry
from fernlog import testlines
from fernlog.sources import readers, store
from fernlog.storage import stored


def lines_of(spark, *texts):
    return spark.createDataFrame([("b", "a.log", i + 1, t) for i, t in enumerate(texts)], "bundle_id string, artifact string, line_no bigint, line string")


def test_har_file(spark, tmp_path):
    entry = {"startedDateTime": "2025-11-03T07:15:00Z", "time": 3100.5, "request": {"method": "PUT", "url": "https://bob@shop.example:8443/my cart?refresh_token=qwerty", "headers": [{"name": "AUTHORIZATION", "value": "bearer 0000.1111.2222.33"}]}, "response": {"status": 500, "bodySize": -1, "content": {"size": 12}}}
    (tmp_path / "x.har").write_text(json.dumps({"log": {"entries": [entry, {"startedDateTime": "nope", "request": {"method": "GET", "url": "::"}, "response": {"status": 200}}]}}))
    (tmp_path / "bad.har").write_text("{")
    entries, bad = readers.read_har(spark, f"file://{tmp_path}")
    assert bad.count() == 1
    entries = entries.withColumn("bundle_id", F.lit("b"))
    s = har.har_summary(entries).first()
    assert (s.requests, s.bytes, s.http5xx, s.slow) == (2, 12, 1, 1)
    assert {r.rule_id for r in har.har_findings(har.har_summary(entries)).collect()} == {"HAR_HTTP_5XX", "HAR_SLOW_REQUESTS"}
    t = har.har_timeline(entries).collect()
    assert len(t) == 1 and t[0].message == "PUT https://shop.example:8443/my%20cart returned 500 in 3100 ms" and t[0].severity == "error"
    kinds = {r.kind: r.matches for r in har.har_privacy(entries).collect()}
    assert kinds == {"authorization": 1, "bearer_token": 1, "password": 1, "email": 1}
    assert [r.host for r in har.har_domains(entries).collect()] == ["shop.example"]


def test_classify(spark):
    rows = [("x/a.har", "{}", "har"), ("app.log", "ERROR", "generic-log"), ("e.xml", "<Event><System/>", "windows-event"), ("p.yaml", "apiVersion: v1\nkind: Pod", "kubernetes-manifest"), ("thread.txt", "java.lang.Thread.State: BLOCKED", "jvm-thread-dump"), ("h.HPROF", "x", "recognized-large-binary-artifact"), ("z", "PK\x03\x04", "archive"), ("b", "a\x00", "unknown-binary"), ("t", "words", "unknown-text"), ("c.env", "A=1", "env-config"), ("access.txt", '1.1.1.1 - - [x] "GET / HTTP/1.1"', "nginx-access")]
    df = spark.createDataFrame([("b", p, bytearray(c.encode())) for p, c, _ in rows], "bundle_id string, path string, content binary")
    got = {r.path: r for r in inventory.inventory(df).collect()}
    assert {p: got[p].type for p, _, _ in rows} == {p: t for p, _, t in rows}
    assert all(r.id == r.sha256[:16] for r in got.values())


@pytest.mark.parametrize(
    ("raw", "want"),
    [("a/b.log", ("a/b.log", "ok")), ("a\\.\\b//c", ("a/b/c", "ok")), ("../x", (None, "path-traversal")), ("/etc", (None, "path-traversal")), ("C:\\x", (None, "path-traversal")), ("a/../..", (None, "path-traversal")), ("", (None, "unsafe-entry")), ("a‮b", (None, "unsafe-entry")), ("x" * 600, (None, "limit-exceeded"))],
)
def test_entry_paths(raw, want):
    assert inventory.clean_path(raw) == want


def test_entry_audit(spark):
    rows = [(1, 1, "a/x", "file", 10, 20), (1, 2, "A/./X", "file", 10, 20), (2, 1, "ok", "file", 1, 251), (3, 1, "d/", "directory", 0, 0), (3, 2, "f", "file", 5, 5), (4, 1, "l", "symlink", 0, 0), (5, 1, "../f", "file", 1, 1), *[(6, k, f"f{k}", "file", 0, 1) for k in range(1, 5)], (7, 1, "a", "file", 0, 60), (7, 2, "b", "file", 0, 60), (8, 1, "a", "file", 0, 101)]
    df = spark.createDataFrame(rows, "bundle_id bigint, entry_no bigint, name string, mode string, compressed bigint, size bigint")
    got = {r.bundle_id: (r.bad_entry, r.code) for r in inventory.audit_entries(df, inventory.Limits(files=3, total_bytes=300, file_bytes=300)).collect()}
    assert got == {1: (2, "unsafe-entry"), 2: (1, "limit-exceeded"), 3: (None, "ok"), 4: (1, "unsafe-entry"), 5: (1, "path-traversal"), 6: (4, "limit-exceeded"), 7: (None, "ok"), 8: (None, "ok")}
    tight = {r.bundle_id: (r.bad_entry, r.code) for r in inventory.audit_entries(df.where("bundle_id > 6"), inventory.Limits(total_bytes=119, file_bytes=100)).collect()}
    assert tight == {7: (2, "limit-exceeded"), 8: (1, "limit-exceeded")}


def test_redaction(spark):
    text = "wrote one@mail.example by 203.0.113.5, then one@mail.example by 203.0.113.5 with pwd: not-a-real-one"
    df = spark.createDataFrame([("e", "b/2.txt", text), ("e", "a/1.txt", "x@y.example then one@mail.example"), ("e", "c", None)], "export string, path string, text string")
    got = {r.path: r for r in sanitize.pseudonymize(df, "strict").collect()}
    assert got["a/1.txt"].text == "EMAIL_001 then EMAIL_002"
    assert got["b/2.txt"].text == "wrote EMAIL_002 by IPV4_001, then EMAIL_002 by IPV4_001 with PASSWORD_001"
    assert got["b/2.txt"].replacements == {"email": 2, "ipv4": 2, "password": 1} and got["c"].text is None
    standard = {r.path: r.text for r in sanitize.pseudonymize(df, "standard").collect()}
    assert "one@mail.example" in standard["b/2.txt"] and "not-a-real-one" not in standard["b/2.txt"]
    fixed = df.select(sanitize.redact(F.col("text"), "strict").alias("t")).where("t is not null").collect()
    assert all("@" not in r.t and "203.0.113.5" not in r.t for r in fixed)


def test_comparison(spark):
    f = "pair string, rule_id string, component string, title string, severity string, id string"
    a = spark.createDataFrame([("p", "R1", None, "t", "low", "1"), ("p", "R2", "c", "t", "high", "2")], f)
    b = spark.createDataFrame([("p", "R1", "", "t", "low", "3"), ("p", "R3", "c", "t", "high", "4"), ("p", "R3", "c", "t", "critical", "5")], f)
    assert [(r.rule_id, r.id) for r in compare.new_findings(a, b).collect()] == [("R3", "4")]
    assert [r.rule_id for r in compare.resolved_findings(a, b).collect()] == ["R2"]
    assert [r.rule_id for r in compare.unchanged_rules(a, b).collect()] == ["R1"]
    assert compare.new_findings(a, a).count() == 0
    assert {r.severity: r.delta for r in compare.severity_delta(a, b).collect()} == {"low": 0, "high": 0, "critical": 1}
    s = "pair string, path string, sha256 string"
    x, y = spark.createDataFrame([("p", "etc/hosts", "1"), ("p", "same", "2")], s), spark.createDataFrame([("p", "etc/hosts", "3"), ("p", "same", "2"), ("p", "var/late", "4")], s)
    assert {r.path: r.change for r in compare.artifact_diff(x, y).collect()} == {"etc/hosts": "changed", "var/late": "added"}


def test_platform_rules(spark):
    dump = lines_of(spark, "idle", *["  java.lang.Thread.State: BLOCKED (on monitor)"] * 4, "found a total of 2 cycles", "a DEADLOCK", "x.OutOfMemoryError: metaspace")
    assert {r.rule_id: r.line_start for r in platform_rules.jvm_findings(dump).collect()} == {"JVM_DEADLOCK_INDICATOR": 7, "JVM_OUT_OF_MEMORY": 8, "JVM_BLOCKED_THREADS": 0}
    gc = lines_of(spark, "[3s] Pause Remark 1000.1ms", "Pause Young 1000ms then 9000ms", "threads stopped 4000ms")
    assert platform_rules.gc_pauses(gc).first().long_pauses == 2
    web = lines_of(spark, "x uncaught exception y", "pool www seems busy", *['a "PUT /"  500 9'] * 5)
    assert {r.rule_id: r.occurrences for r in platform_rules.web_findings(web).collect()} == {"PHP_FATAL_ERROR": 1, "PHP_FPM_CAPACITY": 1, "WEB_REPEATED_5XX": 5}


def test_windows_xml(spark, tmp_path):
    ns = "http://schemas.microsoft.com/win/2004/08/events/event"
    event = '<Event xmlns="{ns}"><System><Provider Name="Disk"/><EventID>{i}</EventID><Level>2</Level><TimeCreated SystemTime="2026-08-01T10:00:00Z"/><Channel>System</Channel></System><EventData><Data>one</Data><Data>two</Data></EventData></Event>'
    (tmp_path / "ok.xml").write_text(f'<Events xmlns="{ns}">' + event.format(ns=ns, i=7) + event.format(ns=ns, i=31337) + "</Events>")
    (tmp_path / "dtd.xml").write_text("<?xml version='1.0'?>\n<!doctype x>" + event.format(ns=ns, i=7))
    rows, refused = readers.read_windows_events(spark, f"file://{tmp_path}")
    got = rows.collect()
    assert len(got) == 2 and got[0].message == "one; two" and got[0].computer == "unknown" and refused.count() == 1
    found = platform_rules.windows_findings(rows.withColumn("bundle_id", F.lit("b"))).collect()
    assert [r.rule_id for r in found] == ["WIN_DISK_WARNING"]


def test_reading_lines_and_archives(spark, tmp_path):
    import gzip
    import io
    import tarfile
    import zipfile

    logs_dir = tmp_path / "logs"
    logs_dir.mkdir()
    (logs_dir / "a.log").write_bytes(b"".join(b"line %d\r\n" % k for k in range(5000)))
    (logs_dir / "b.log.gz").write_bytes(gzip.compress(b"x\ny\n"))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    try:
        got = readers.read_lines(spark, f"file://{logs_dir}").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    a = {r.line_no: r.line for r in got if r.artifact.endswith("a.log")}
    assert a == {k + 1: f"line {k}" for k in range(5000)}
    assert sorted((r.line_no, r.line) for r in got if r.artifact.endswith("gz")) == [(1, "x"), (2, "y")]
    z, t = io.BytesIO(), io.BytesIO()
    with zipfile.ZipFile(z, "w") as f:
        f.writestr("d/one.txt", "1")
        f.writestr("two.txt", "22")
    with tarfile.open(fileobj=t, mode="w:gz") as f:
        info = tarfile.TarInfo("three.txt")
        info.size = 3
        f.addfile(info, io.BytesIO(b"333"))
    bundles = tmp_path / "bundles"
    bundles.mkdir()
    for name, data in (("a.zip", z.getvalue()), ("b.tar.gz", t.getvalue()), ("c.gz", gzip.compress(b"4444")), ("d.zip", b"PK\x03\x04broken")):
        (bundles / name).write_bytes(data)
    rows = readers.expand_bundles(readers.read_artifacts(spark, f"file://{bundles}")).collect()
    assert sorted((r.name, r.size) for r in rows if r.name) == [("c", 4), ("d/one.txt", 1), ("three.txt", 3), ("two.txt", 2)]
    assert [r.warning for r in rows if r.warning] == ["archive is malformed: BadZipFile"]


def test_store_and_rule_pack(spark, tmp_path):
    rows = lines_of(spark, "2026-08-01T10:00:00Z ERROR connection refused")
    entries = spark.createDataFrame([("b", "x.har", 0, "2026-08-01T10:00:00Z", 1.0, "GET", "http://h/p", 404, 1, 1)], "bundle_id string, artifact string, entry bigint, started string, time_ms double, method string, url string, status int, body_size bigint, content_size bigint")
    hashed = lambda df: df.withColumn("sha256", F.sha2("artifact", 256))
    entries = entries.withColumns({"headers": F.array().cast("array<struct<name string, value string>>"), "has_body": F.lit(False), "ttfb_ms": F.lit(0.5)})
    tables = analyze(hashed(rows), hashed(entries))
    tables["findings"] = logs.full_findings(tables["findings"])
    assert tables.pop("capped").count() == 0 and analyze(hashed(rows), hashed(entries), findings=1)["capped"].count() == 1
    assert {r.rule_id for r in tables["findings"].collect()} == {"LOG_CONNECTION_REFUSED", "HAR_HTTP_4XX"} and tables["timeline"].count() == 2
    path = f"file://{tmp_path}/ws"
    store.write_workspace(tables, path)
    back = store.load_workspace(spark, path)
    assert set(back) == {"findings", "timeline", "sensitive"} and back["findings"].count() == 2 and back["timeline"].where("evidence.status = 404").count() == 1
    with pytest.raises(ValueError, match="already exists"):
        store.write_workspace(tables, path)
    more = back["findings"].withColumn("severity", F.explode(F.array(*map(F.lit, ["info", "low", "medium", "critical"]))))
    payload = store.report_payload(more, back["timeline"], sensitive=back["sensitive"], most=3).first().payload
    assert [f["severity"] for f in json.loads(base64.b64decode(payload))["findings"]] == ["critical", "critical", "medium"]
    one = {"id": "MY_RULE", "title": "a title", "category": "own", "severity": "low", "pattern": "REFUSED", "confidence": "weak"}
    pack = lambda **more: json.dumps({"version": "1", "name": "own-rules", "rules": [one | more]})
    found = logs.log_findings(rows, store.load_rule_pack(pack())).collect()
    assert [(r.rule_id, r.confidence) for r in found] == [("MY_RULE", "weak")]
    assert logs.log_findings(rows, store.load_rule_pack(pack(), ignore_case=False)).count() == 0
    for bad, why in (({"id": "x"}, "bad rule id"), ({"title": "ab"}, "bad title"), ({"confidence": "sure"}, "bad confidence"), ({"severity": "none"}, "bad severity"), ({"more": "1"}, "a rule has")):
        with pytest.raises(ValueError, match=why):
            store.load_rule_pack(pack(**bad))
    old, new = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"), spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string")
    assert sorted(map(tuple, store.upsert_dim(old, new, "k").collect())) == [(1, "a"), (2, "c"), (3, "d")]
    records = ['{"type":"finding","finding":{"ruleId":"R","evidence":[{"artifact":"a","lineStart":3}],"nextSteps":["s"]}}', "not json", '{"type":"summary"}', '{"type":"warning","warning":"w"}', '{"type":"timeline_event","event":{"message":"m","evidence":{"line":4}}}', '{"type":"finding"}', "null", "[1]"]
    (tmp_path / "o.jsonl").write_text("\n".join(records) + "\n")
    (tmp_path / "p.jsonl").write_text("\n".join([records[0]] * 3) + "\n")
    got = readers.read_analyzer_output(spark, f"file://{tmp_path}/*.jsonl", most=2)
    assert sorted(r.ruleId for r in got["findings"].collect()) == ["R"] * 3 and got["findings"].first().evidence[0].lineStart == 3
    assert [(r.message, r.evidence) for r in got["events"].collect()] == [("m", '{"line":4}')]
    invalid, unknown = "analyzer emitted invalid JSON", "analyzer emitted an unsupported response type"
    assert [r.warning for r in got["warnings"].orderBy("at").collect()] == [invalid, unknown, "w", unknown, invalid]
    assert sorted(r.status for r in got["runs"].collect()) == ["completed", "completed_with_warnings"]


def test_queries_pages_and_audits(spark):
    df = spark.createDataFrame([(1,), (2,), (3,)], "id int")
    rows, cursor = query.page(df, ["id"], None, 2)
    assert [r.id for r in rows] == [1, 2]
    rows, cursor = query.page(df, ["id"], cursor, 2)
    assert [r.id for r in rows] == [3] and cursor is None
    with pytest.raises(ValueError):
        query.decode_cursor(query.encode_cursor(1)[:-1] + "!x")
    bad = spark.createDataFrame([Row(sha256="z", size=-1, path="../a", type="t"), Row(sha256="a" * 64, size=1, path="a", type="t")])
    assert {r.rule: r.broken for r in audit.check_schema(bad, "artifact").collect()} == {"sha256_format": 1, "size_not_negative": 1, "path_relative": 1, "type_present": 0}
    assert audit.duplicate_keys(bad, ["type"]).first().rows == 2
    assert audit.fk_violations(df, df.where("id > 1"), "id").collect()[0].id == 1


def test_workspace_rules_break(spark):
    e = "array<struct<artifact string, line_start bigint, line_end bigint, excerpt string>>"
    f = spark.createDataFrame([("", "bad id", "t", "none", None, "s", "moderate", 0, [], None), ("i", "R_1", "t", "low", "c", "s", "exact", 1, [(None, 3, 2, "x" * 5000)], [])], f"id string, rule_id string, title string, severity string, category string, summary string, confidence string, occurrences bigint, evidence {e}, next_steps array<string>")
    s = spark.createDataFrame([("done", "2025-01-02", "2025-01-01", -1), ("failed", None, "2025-01-01", 0)], "status string, started_at string, completed_at string, warning_count int")
    tables = {"findings": f, "sessions": s, "pairs": spark.createDataFrame([("a", "a"), ("a", "b")], "baseline string, incident string"), "reports": spark.createDataFrame([("pdf", "00")], "format string, sha256 string"), "other": s}
    got = {(r.table, r.rule): r.broken for r in audit.audit_workspace(tables).collect()}
    assert {k for k, n in got.items() if n == 0} == {("findings", "title_present"), ("findings", "summary_present")}
    assert got["findings", "confidence_in_schema"] == got["findings", "confidence_in_store"] == 1 and got["sessions", "times_in_order"] == 1


def test_registry(spark):
    reg = Registry()
    reg.register("good", ["log"], logs.log_findings)
    reg.register("bad", ["log"], lambda df: df.select("no_such_column"))
    reg.register("late", ["log"], lambda df: df.select("bundle_id", F.raise_error(F.lit("at run time")).alias("rule_id")))
    found, runs = reg.run(lines_of(spark, "connection refused").withColumn("type", F.lit("log")))
    assert found.count() == 1 and [r["status"] for r in runs] == ["completed", "failed", "failed"]


def test_streams(spark, tmp_path):
    from fernlog.streaming import jobs

    src = tmp_path / "in"
    src.mkdir()
    rows = [{"bundle_id": "b", "artifact": "a.log", "line_no": k, "line": f"2026-08-01T10:00:0{k}Z ERROR failed job {100 + k}"} for k in range(6)]
    (src / "1.json").write_text("\n".join(map(json.dumps, rows)))
    stream = spark.readStream.schema("bundle_id string, artifact string, line_no bigint, line string").json(f"file://{src}")

    def run(df, name, mode):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", f"file://{tmp_path}/{name}").trigger(availableNow=True).start()
        q.awaitTermination(60)
        return spark.table(name).collect()

    assert len(run(jobs.stream_timeline(stream), "t1", "append")) == 6
    parsed = logs.parse_log_b(stream)
    assert max(r.errors for r in run(jobs.stream_bursts(parsed), "t2", "update")) == 6
    assert [r.errors for r in run(jobs.stream_patterns(parsed), "t3", "update")] == [6]
    events = spark.createDataFrame([(1, 1, "queued"), (1, 2, "completed"), (2, 1, "running")], "session_id int, sequence int, stage string")
    events.write.json(f"file://{tmp_path}/ev")
    progress = spark.readStream.schema("session_id int, sequence int, stage string").json(f"file://{tmp_path}/ev")
    assert {r.session_id: (r.stage, r.ended) for r in run(jobs.stream_sessions(progress), "t4", "complete")} == {1: ("completed", True), 2: ("running", False)}
    assert datetime(2026, 8, 1, 10) in {r.ts for r in spark.table("t1").collect()}


def test_entries_are_shuffled_by_their_windows_alone(spark, sf_dir, monkeypatch):
    """Stored entries aren't dealt out again behind the window that numbers them, and the audit shuffles neither names nor modes, once for both windows."""
    seen = []
    monkeypatch.setattr(testlines, "stored", lambda df, name: (seen.append(df), stored(df, name))[1])
    entries = testlines.derived(spark, sf_dir + "/", "entries")
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert plan(seen[0]).count("Exchange") == 1
    audited = plan(inventory.audit_entries(entries))
    assert audited.count("Exchange") == 1 and "mode#" not in audited[: audited.index("Exchange")]
