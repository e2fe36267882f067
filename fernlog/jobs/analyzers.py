"""The job of all analyzers: each artifact goes to the analyzers of its type; what one of them can't read costs only that artifact."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fernlog import patterns as P
from fernlog.functions import scalars as S
from fernlog.operators import intelligence, inventory, logs, platform_rules
from fernlog.operators.logs import K
from fernlog.sources import readers
from fernlog.storage import small, stored

#: Most findings of an analyzer in a bundle.
MOST = 10_000
#: Artifacts' names that may be broadcast.
BROADCAST_FILES = 1_000_000
_FINDING = "bundle_id string, artifact string, rule_id string, title string, severity string, summary string, confidence string, occurrences bigint, line_start bigint, excerpt string, warning string"


def planned(artifacts: DataFrame, analyzers: list[tuple] = P.ANALYZERS) -> DataFrame:
    """Artifacts (bundle_id, path, content) with their type and ``analyzer``, stored by analyzer; those that none reads are left out.

    The analyzers' types are a constant of few rows, which goes to the artifacts; their bytes aren't shuffled.
    """
    spark = artifacts.sparkSession
    plan = spark.createDataFrame([(n, t) for n, types in analyzers for t in types], "analyzer string, _type string")
    alias = F.create_map(*[F.lit(x) for kv in inventory.ALIASES.items() for x in kv])
    rows = inventory.typed(artifacts.select("bundle_id", "path", "content")).withColumn("type", F.coalesce(F.try_element_at(alias, F.col("type")), F.col("type")))
    rows = rows.join(F.broadcast(plan), F.col("type") == F.col("_type")).select("bundle_id", F.col("path").alias("artifact"), "content", "sha256", "type", "analyzer")
    return stored(rows, "planned", by="analyzer")


def run_analyzers(artifacts: DataFrame, analyzers: list[tuple] = P.ANALYZERS, own: dict[str, Callable[[str, bytes], list[dict]]] | None = None) -> dict[str, DataFrame]:
    """``findings`` of all analyzers in their stored form with ``analyzer``, and ``runs``: bundle_id, name, version, status, warnings.

    ``artifacts`` has bundle_id, path, content. The built-in analyzers read logs (repeated errors, bursts), web logs, JVM dumps and collector
    logs, and Windows event XML. ``own`` has further ones by a name in ``analyzers``: functions from an artifact's path and bytes to findings (dicts). An artifact that
    an analyzer can't read gives a warning of that run, which is then completed_with_warnings, and no finding; the others' findings stay. A
    bundle has a run of each analyzer that some artifact of it is planned for. At most MOST findings of an analyzer in a bundle are kept, most severe first.
    """
    held = planned(artifacts, analyzers)
    of = lambda name: held.where(F.col("analyzer") == name)
    text = {name: _readable(readers.split_lines(of(name).where(~F.col("type").isin("jvm-heap-dump", "windows-evtx")))) for name in ("jvm", "logs", "web")}
    events, bad_xml = windows_events(of("windows").where("type = 'windows-event-xml'"))
    found = {
        "logs": intelligence.intelligence_findings(logs.parse_log_b(text["logs"][0])),
        "web": platform_rules.web_findings(text["web"][0]),
        "jvm": platform_rules.jvm_findings(text["jvm"][0]).unionByName(platform_rules.heap_dumps(of("jvm").where("type = 'jvm-heap-dump'").withColumnRenamed("artifact", "path"))),
        "windows": platform_rules.windows_findings(events).drop("event_id"),
    }
    notes = [text[name][1].select("bundle_id", F.lit(name).alias("analyzer"), *_note()) for name in text]
    notes.append(bad_xml.select("bundle_id", F.lit("windows").alias("analyzer"), *_note()))
    for name, fn in (own or {}).items():
        rows = stored(each_artifact(of(name), fn), "own")
        found[name] = rows.where("warning IS NULL").drop("warning")
        notes.append(rows.where("warning IS NOT NULL").select("bundle_id", F.lit(name).alias("analyzer"), *_note()))
    hashes = held.select(*K, "sha256").distinct()
    full = None
    for name, rows in found.items():
        rows = rows.join(small(hashes, BROADCAST_FILES), K)
        fingerprint = F.col("excerpt") if name == "logs" else F.lit(None).cast("string")
        ids = logs.with_ids(rows.withColumn("fingerprint", fingerprint))
        one = logs.full_findings(ids, category=name).select(F.lit(name).alias("analyzer"), *logs.FULL)
        full = one if full is None else full.unionByName(one)
    capped = logs.cap_findings(full.withColumn("_by", F.concat_ws("\0", "bundle_id", "analyzer")).withColumnRenamed("bundle_id", "_bundle").withColumnRenamed("_by", "bundle_id"), MOST, (S.severity_rank(F.col("severity")).desc(), "id", "rule_id", "summary"))
    findings = capped.drop("bundle_id").withColumnRenamed("_bundle", "bundle_id")
    warned = notes[0]
    for n in notes[1:]:
        warned = warned.unionByName(n)
    warned = warned.groupBy("bundle_id", "analyzer").agg(F.transform(F.sort_array(F.collect_list("note")), lambda n: F.concat_ws(": ", n["artifact"], n["warning"])).alias("warnings"))
    runs = held.select("bundle_id", "analyzer").distinct().join(warned, ["bundle_id", "analyzer"], "left")
    warnings = F.coalesce("warnings", F.array().cast("array<string>"))
    status = F.when(F.size(warnings) > 0, "completed_with_warnings").otherwise("completed")
    return {"findings": findings, "runs": runs.select("bundle_id", F.col("analyzer").alias("name"), F.lit(P.TOOL_VERSION).alias("version"), status.alias("status"), warnings.alias("warnings"))}


def _note() -> list[Column]:
    return [F.struct("artifact", "warning").alias("note")]


def _readable(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Lines of the artifacts without a line of 1 MiB, and a warning for each of the others."""
    failed = stored(logs.failed_files(lines), "failed")
    return lines.join(small(failed.select(*K), BROADCAST_FILES), K, "left_anti"), failed


def windows_events(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Events of event XML (K, content) in the form that ``windows_findings`` takes, and the artifacts that are refused with a warning: those that declare a
    document type, and those that are no XML."""
    text = F.make_valid_utf8(F.col("content").cast("string"))
    schema = f"Event array<struct<{readers.EVENT_SCHEMA}>>, {readers.EVENT_SCHEMA}, _bad string"
    rows = files.select(*K, text.rlike("(?i)<!DOCTYPE").alias("declares"), text.alias("text"))
    parsed = rows.where("NOT declares").select(*K, F.from_xml("text", schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("x"))
    parsed = stored(parsed.select(*K, F.coalesce(F.col("x._bad").isNotNull(), F.lit(True)).alias("bad"), F.coalesce("x.Event", F.array(F.struct("x.System", "x.EventData"))).alias("events")), "events")
    refused = rows.where("declares").select(*K, F.lit("document types are not allowed").alias("warning"))
    refused = refused.unionByName(parsed.where("bad").select(*K, F.lit("event XML is malformed").alias("warning")))
    each = parsed.where("NOT bad").select(*K, F.posexplode("events").alias("position", "e")).where("e.System IS NOT NULL")
    number = F.when(F.col("e.System.EventID").rlike("^[0-9]+$"), F.expr("try_cast(e.System.EventID AS INT)"))
    return each.select(*K, "position", number.alias("event_id"), F.coalesce(F.array_join("e.EventData.Data", "; "), F.lit("")).alias("message")), refused


def each_artifact(files: DataFrame, fn: Callable[[str, bytes], list[dict]]) -> DataFrame:
    """Findings that ``fn`` gives for each artifact (K, content) by itself; whatever it raises becomes a row with a ``warning``.

    A finding needs rule_id, title and severity. A task holds one artifact and its findings.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns = [x.split()[0] for x in _FINDING.split(", ")]
        kinds = [pa.int64() if x.endswith("bigint") else pa.string() for x in _FINDING.split(", ")]
        for batch in batches:
            for bundle, path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                try:
                    rows = [{"summary": "", "confidence": "moderate", "occurrences": 1} | f | {"bundle_id": bundle, "artifact": path, "warning": None} for f in fn(path, content.as_py() or b"")]
                    if any(not isinstance(r.get(k), str) for r in rows for k in ("rule_id", "title", "severity")):
                        raise ValueError("a finding needs rule_id, title and severity")
                    out = [pa.array([r.get(c) for r in rows], k) for c, k in zip(columns, kinds, strict=True)]
                except Exception as e:  # noqa: BLE001  whatever an analyzer raises is about this artifact alone
                    row = {"bundle_id": bundle, "artifact": path, "warning": f"{type(e).__name__}: {e}"[:300]}
                    out = [pa.array([row.get(c)], k) for c, k in zip(columns, kinds, strict=True)]
                yield pa.RecordBatch.from_arrays(out, columns)

    return files.select(*K, "content").mapInArrow(run, _FINDING)
