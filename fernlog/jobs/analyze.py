"""The main job: lines and requests, artifacts, or archives of many bundles to the tables of a workspace."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fernlog import patterns as P
from fernlog.operators import har, inventory, logs
from fernlog.operators.inventory import Limits
from fernlog.sources import readers
from fernlog.sources.store import report_payload, write_workspace
from fernlog.storage import keep_only, made, small, stored

#: Rows of small tables (bundles, files) that may be broadcast.
BROADCAST_FILES = 1_000_000
_EVIDENCE = "struct<line bigint, json_pointer string, status int, duration_ms double, ttfb_ms double>"
_EVENT = ["bundle_id", "ts", "source", "component", "severity", "category", "message", "artifact", "correlation_id", "evidence"]


def analyze_lines(lines: DataFrame, tz: str = "UTC", rules: list[tuple] = P.LOG_RULES) -> dict[str, DataFrame]:
    """Findings, timeline and sensitive counts of log lines, uncapped but for the events of each file.

    ``lines`` has K, line_no, line and may have sha256, the file's hash, without which findings have no id. What the three take from a line
    is worked out in one pass and stored.
    """
    return _from_facts(stored(logs.line_facts(lines, rules, tz), "facts"), rules)


def _from_facts(facts: DataFrame, rules: list[tuple]) -> dict[str, DataFrame]:
    found = logs.findings_of(facts, rules)
    return {
        "findings": logs.with_ids(found) if "sha256" in found.columns else found,
        "timeline": logs.cap_timeline(logs.timeline_of(facts)),
        "sensitive": logs.sensitive_of(facts),
    }


def _events(log: DataFrame, web: DataFrame) -> DataFrame:
    """Events of both sources with their evidence: the line, or the entry and its times."""
    none = lambda kind: F.lit(None).cast(kind)
    a = log.withColumn("evidence", F.struct(F.col("line_no").alias("line"), none("string").alias("json_pointer"), none("int").alias("status"), none("double").alias("duration_ms"), none("double").alias("ttfb_ms")).cast(_EVIDENCE))
    b = web.withColumn("evidence", F.struct(none("bigint").alias("line"), "json_pointer", "status", F.col("time_ms").alias("duration_ms"), "ttfb_ms").cast(_EVIDENCE))
    return a.select(*_EVENT).unionByName(b.withColumn("correlation_id", none("string")).select(*_EVENT))


def analyze(lines: DataFrame, entries: DataFrame, tz: str = "UTC", findings: int = 10_000) -> dict[str, DataFrame]:
    """Findings, timeline and sensitive counts of log lines and requests, in one table each.

    The cap of findings applies to all of a bundle's findings, in path order; ``capped`` are the bundles with more than that.
    ``lines`` and ``entries`` have sha256.
    """
    return _both(analyze_lines(lines, tz), entries, findings)


def _both(out: dict[str, DataFrame], entries: DataFrame, findings: int) -> dict[str, DataFrame]:
    hashes = entries.select(*logs.K, "sha256").distinct()
    web = har.har_findings(har.har_summary(entries).join(hashes, logs.K))
    web = web.withColumns({"component": F.lit(""), "fingerprint": F.lit(None).cast("string")})
    both = stored(logs.union_findings(out["findings"].drop("id"), web), "findings")
    place = F.array_position(F.array(*map(F.lit, P.HAR_ORDER)), F.col("rule_id"))
    capped = logs.cap_findings(both, findings, ("artifact", place, "rule_id", "component", "fingerprint"))
    return {
        "findings": capped.transform(logs.with_ids),
        "capped": both.groupBy("bundle_id").count().where(F.col("count") > findings).select("bundle_id"),
        "timeline": _events(out["timeline"], har.har_timeline(entries)),
        "sensitive": out["sensitive"].unionByName(har.har_privacy(entries)),
    }


def analyze_artifacts(artifacts: DataFrame, tz: str = "UTC", limits: Limits = Limits(), rules: list[tuple] = P.LOG_RULES) -> dict[str, DataFrame]:
    """All tables of a workspace but those that need the archives: ``artifacts`` has bundle_id, path (unique in it), content.

    Logs, HTTP archives and other texts go to their analyses by type. A log with a line of 1 MiB and an archive that is no
    JSON give a warning and nothing else; a text with a NUL has no sensitive counts. Logs are matched against ``rules``.
    """
    held = inventory.route(inventory.typed(artifacts.select("bundle_id", "path", "content")))
    return _workspace(stored(held, "contents", by="route"), tz, limits, rules)


def _workspace(held: DataFrame, tz: str, limits: Limits, rules: list[tuple]) -> dict[str, DataFrame]:
    """Tables of ``held`` artifacts: the stored bytes with type, hash and route. Each analysis reads the files of its own route, once;
    of the bytes nothing is shuffled, and no second copy is written."""
    routed = held.drop("content")
    files = held.withColumnRenamed("path", "artifact")
    facts = stored(logs.line_facts(readers.split_lines(files.where("route = 'log'")), rules, tz), "facts")
    failed = stored(logs.failed_of(facts), "failed")
    good = facts.join(small(failed.select(*logs.K), BROADCAST_FILES), logs.K, "left_anti")
    entries, bad = readers.read_entries(files.where("route = 'har'"))
    out = _both(_from_facts(good, rules), entries, limits.findings)
    others = readers.split_lines(files.where("route = 'privacy-only'"))
    out["sensitive"] = out["sensitive"].unionByName(logs.privacy_counts(others, "line", logs.K, nul_hides=True))

    out["findings"] = logs.full_findings(out["findings"])
    out["timeline"] = stored(out["timeline"], "timeline")
    many = out["timeline"].where("source = 'log'").groupBy(*logs.K).count().where(F.col("count") >= limits.events)
    named = lambda df: df.select("bundle_id", "artifact", F.concat("artifact", F.lit(": "), "warning").alias("warning"))
    runs = named(failed).unionByName(named(bad)).unionByName(many.select(*logs.K, F.lit(P.MANY_EVENTS).alias("warning")))
    notes = stored(inventory.bundle_warnings(routed, runs, out.pop("capped")), "notes")
    out["artifacts"] = routed.select("bundle_id", "id", "path", "type", "sha256", "size")
    out["runs"] = notes.select("bundle_id", F.lit(P.RUN_NAME).alias("name"), F.lit(P.TOOL_VERSION).alias("version"), "status", F.col("run_warnings").alias("warnings"))
    out["manifest"] = notes.select("bundle_id", F.lit(P.TOOL_VERSION).alias("tool_version"), F.lit(P.SCHEMA_VERSION).alias("schema_version"), F.col("artifacts").alias("artifact_count"), "warnings", limits.column().alias("limits"))
    return out


def analyze_bundles(spark: SparkSession, archives: str, output: str, tz: str = "UTC", limits: Limits = Limits(), rules: list[tuple] = P.LOG_RULES) -> None:
    """Archives to a workspace: expand, audit, inventory, route, analyse, cap, sort, report, write; published when it is complete.

    A bundle is named by its file. An archive is audited while it is read: one that breaks a limit, or is unsafe or broken, is left out as
    a whole and listed with its code in the table ``rejected``; the others go on. Each entry's bytes are hashed, typed, routed and stored
    where they are inflated. ``rules`` may come from ``store.load_rule_pack``. The scratch tables are deleted in the end.
    """
    before = made()
    name = F.element_at(F.split("bundle_id", "/"), -1)
    opened = readers.expand_bundles(readers.read_archives(spark, archives), limits).select(name.alias("bundle_id"), "path", "content", "code", "input_sha256")
    held = inventory.route(inventory.typed(opened))
    held = stored(held.withColumn("route", F.when(F.col("code").isNotNull(), "verdict").otherwise(F.col("route"))), "contents", by="route")
    verdicts = held.where("route = 'verdict'").select("bundle_id", "code", "input_sha256")
    rejected = stored(verdicts.where("code != 'ok'").select("bundle_id", "code"), "rejected")
    # few bundles are rejected: only their names go to the contents
    own = held.where("route != 'verdict'").drop("code", "input_sha256").join(small(rejected.select("bundle_id"), BROADCAST_FILES), "bundle_id", "left_anti")
    tables = _workspace(own, tz, limits, rules)
    tables["manifest"] = tables["manifest"].join(verdicts.select("bundle_id", F.col("bundle_id").alias("input_name"), "input_sha256"), "bundle_id")
    tables["rejected"] = rejected
    tables = {k: stored(v, k) for k, v in tables.items()}
    tables["report"] = report_payload(tables["findings"], tables["timeline"], tables["manifest"], tables["sensitive"])
    write_workspace(tables, output)
    keep_only(spark, before)
