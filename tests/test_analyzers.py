"""All analyzers over artifacts, some of which they can't read."""

import pytest
from pyspark.sql import functions as F

from fernlog import patterns as P
from fernlog.jobs import analyzers

EVENT = "<Event xmlns='http://schemas.microsoft.com/win/2004/08/events/event'><System><EventID>{}</EventID></System><EventData><Data>a</Data><Data>b</Data></EventData></Event>"
KNOWN = P.WINDOWS_EVENTS[0]


def table(spark, files):
    return spark.createDataFrame([(b, p, None if c is None else bytearray(c if isinstance(c, bytes) else c.encode())) for b, p, c in files], "bundle_id string, path string, content binary")


def test_each_bad_artifact_costs_itself_alone(spark):
    files = [
        ("a", "ev/one.xml", EVENT.format(KNOWN[0])), ("a", "ev/many.xml", "<Events>" + EVENT.format(KNOWN[0]) * 2 + EVENT.format("x") + EVENT.format(424242) + "</Events>"), ("a", "ev/torn.xml", "<Events>" + EVENT.format(KNOWN[0])),
        ("a", "ev/dtd.xml", "<!DOCTYPE x><Events>" + EVENT.format(KNOWN[0]) + "</Events>"), ("a", "dump.hprof", b"JAVA PROFILE\0\1"), ("a", "app.log", "\n".join(["2025-01-01T00:00:00Z ERROR failed"] * 6)),
        ("a", "nginx/error.log", "upstream timed out while reading"), ("b", "app.log", "y" * (1 << 20) + "\nERROR x"), ("b", "good.log", "2025-01-01T00:00:00Z ERROR good"), ("b", "notes", "nobody reads this"), ("b", "thread.txt", "java.lang.Thread.State: BLOCKED\n" * 3),
    ]
    t = analyzers.run_analyzers(table(spark, files))
    found = {(r.bundle_id, r.analyzer, r.rule_id, r.evidence[0].artifact if r.evidence else None): r for r in t["findings"].collect()}
    assert {(b, a, r) for b, a, r, _ in found} == {("a", "windows", KNOWN[1]), ("a", "jvm", "JVM_HEAP_DUMP_RECOGNIZED"), ("a", "logs", "PY_REPEATED_ERROR"), ("a", "logs", "PY_ERROR_BURST"), ("a", "web", "WEB_UPSTREAM_TIMEOUT"), ("b", "logs", "PY_REPEATED_ERROR"), ("b", "jvm", "JVM_BLOCKED_THREADS")}
    assert found["a", "windows", KNOWN[1], "ev/many.xml"].occurrences == 2 and found["a", "windows", KNOWN[1], "ev/one.xml"].evidence[0].excerpt == "a; b"
    assert found["a", "windows", KNOWN[1], "ev/one.xml"].category == "windows" and found["a", "windows", KNOWN[1], "ev/one.xml"].id.startswith("f-")
    runs = {(r.bundle_id, r.name): (r.status, r.warnings) for r in t["runs"].collect()}
    assert runs == {
        ("a", "windows"): ("completed_with_warnings", ["ev/dtd.xml: document types are not allowed", "ev/torn.xml: event XML is malformed"]),
        ("a", "jvm"): ("completed", []),
        ("a", "logs"): ("completed", []),
        ("a", "web"): ("completed", []),
        ("b", "logs"): ("completed_with_warnings", ["app.log: line is 1 MiB long or longer"]),
        ("b", "jvm"): ("completed", []),
    }


def test_own_analyzers_fail_for_one_artifact_alone(spark):
    def sizes(path, content):
        if b"bad" in content:
            raise RuntimeError("cannot read this")
        if b"odd" in content:
            return [{"rule_id": "NO_TITLE"}]
        return [{"rule_id": "SIZE", "title": "Size", "severity": "info", "occurrences": len(content), "excerpt": path}]

    files = [("a", "x.toml", "12345"), ("a", "y.toml", "bad"), ("b", "z.toml", "odd"), ("b", "w.toml", None), ("c", "v.log", "no toml")]
    t = analyzers.run_analyzers(table(spark, files), [*P.ANALYZERS, ("sizes", ["toml-config"])], {"sizes": sizes})
    assert sorted((r.bundle_id, r.occurrences, r.evidence[0].excerpt) for r in t["findings"].where("analyzer = 'sizes'").collect()) == [("a", 5, "x.toml"), ("b", 0, "w.toml")]
    runs = {(r.bundle_id, r.name): (r.status, r.warnings) for r in t["runs"].collect()}
    assert runs["a", "sizes"] == ("completed_with_warnings", ["y.toml: RuntimeError: cannot read this"])
    assert runs["b", "sizes"] == ("completed_with_warnings", ["z.toml: ValueError: a finding needs rule_id, title and severity"])
    assert runs["c", "logs"] == ("completed", [])


def test_no_artifacts(spark):
    t = analyzers.run_analyzers(table(spark, []))
    assert t["findings"].count() == 0 and t["runs"].count() == 0


def test_contents_are_not_shuffled(spark):
    held = table(spark, [("a", "app.log", "x")])
    plan = analyzers.inventory.typed(held).join(F.broadcast(spark.createDataFrame([("logs", "generic-log")], "analyzer string, _type string")), F.col("type") == F.col("_type"))
    assert "Exchange hashpartitioning" not in plan._jdf.queryExecution().executedPlan().toString()
    assert analyzers.planned(held).count() == 1


@pytest.mark.parametrize("text", ["", "<Events/>", "<Events></Events>", "no xml"])
def test_event_files_without_events(spark, text):
    files = spark.createDataFrame([("a", "e.xml", bytearray(text.encode()))], "bundle_id string, artifact string, content binary")
    events, refused = analyzers.windows_events(files)
    assert events.count() == 0 and refused.count() == (0 if text.startswith("<") else 1)
