"""Writing and reading workspaces and the store of normalised tables."""

from __future__ import annotations

import json
import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fernlog import patterns as P
from fernlog.functions import scalars as S
from fernlog.storage import exists, publish, remove, small

#: Sessions that may be broadcast.
BROADCAST_SESSIONS = 1_000_000

# The tables of a workspace and their columns.
_EVIDENCE = "array<struct<artifact string, line_start bigint, line_end bigint, json_pointer string, timestamp string, excerpt string>>"
SCHEMAS = {
    "manifest": "bundle_id string, tool_version string, schema_version string, input_name string, input_sha256 string, artifact_count bigint, warnings array<string>, limits map<string,bigint>",
    "artifacts": "bundle_id string, id string, path string, type string, sha256 string, size bigint",
    "findings": f"bundle_id string, id string, rule_id string, title string, severity string, category string, component string, summary string, explanation string, confidence string, evidence {_EVIDENCE}, next_steps array<string>, `references` array<string>, occurrences bigint",
    "timeline": "bundle_id string, ts timestamp, source string, component string, severity string, category string, message string, artifact string, correlation_id string, evidence struct<line bigint, json_pointer string, status int, duration_ms double, ttfb_ms double>",
    "sensitive": "bundle_id string, artifact string, kind string, matches bigint",
    "runs": "bundle_id string, name string, version string, status string, warnings array<string>",
    "rejected": "bundle_id string, code string",
    "report": "bundle_id string, payload string",
}
TABLES = list(SCHEMAS)


def _order(name: str, columns: list[str]) -> list[Column]:
    """Order of a table inside a bundle: findings by severity and id, events by time and artifact, artifacts by path."""
    orders = {
        "findings": [S.severity_rank(F.col("severity")).desc(), *[F.col(c) for c in ("id", "rule_id") if c in columns]],
        "timeline": [F.col(c) for c in ("ts", "artifact", "line_no") if c in columns],
        "artifacts": [F.col("path")],
        "sensitive": [F.col("artifact"), F.col("kind")],
    }
    return [F.col("bundle_id"), *orders.get(name, [])]


def write_workspace(tables: dict[str, DataFrame], path: str) -> None:
    """Each table as Parquet by bundle, in order inside its files; all of it appears at ``path`` at once, when it is complete.

    What exists there is refused before anything is written. A failed write leaves nothing at ``path``.
    """
    spark = next(iter(tables.values())).sparkSession
    if exists(spark, path):
        raise ValueError(f"output path already exists: {path}")
    staging = f"{path.rstrip('/')}.partial-{uuid.uuid4().hex}"
    try:
        for name, df in tables.items():
            order = _order(name, df.columns)
            df.repartitionByRange(*order).sortWithinPartitions(*order).write.partitionBy("bundle_id").parquet(f"{staging}/{name}")
        publish(spark, staging, path)
    except BaseException:
        remove(spark, staging)
        raise


def load_workspace(spark: SparkSession, path: str, names: list[str] | None = None) -> dict[str, DataFrame]:
    """The tables of a workspace with their fixed schemas, so that an empty table reads like any other."""
    out = {}
    for n in names or [n for n in TABLES if exists(spark, f"{path}/{n}")]:
        out[n] = spark.read.schema(T._parse_datatype_string(SCHEMAS[n])).parquet(f"{path}/{n}")
    return out


def write_store(tables: dict[str, DataFrame], path: str) -> None:
    """Tables by session; filters on the session then read only its files.

    What a session had in a table before is replaced, so that a second run leaves one copy, and a run that failed can be repeated. When all
    tables are there the sessions are entered in ``commits`` with their tables and rows; ``load_store`` only gives sessions that are.
    """
    spark = next(iter(tables.values())).sparkSession
    counts = None
    for name, df in tables.items():
        df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("session_id").parquet(f"{path}/{name}")
        kind = df.schema["session_id"].dataType
        own = spark.read.schema(f"session_id {kind.simpleString()}").parquet(f"{path}/{name}").groupBy("session_id").agg(F.count("*").alias("rows"))
        own = own.join(df.select("session_id").distinct(), "session_id", "left_semi").select("session_id", F.lit(name).alias("table"), "rows")
        counts = own if counts is None else counts.unionByName(own)
    counts.repartition("session_id").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("session_id").parquet(f"{path}/commits")


def load_store(spark: SparkSession, path: str, name: str) -> DataFrame:
    """A table of the store: the rows of the sessions that were written whole."""
    done = spark.read.parquet(f"{path}/commits").where(F.col("table") == name).select("session_id")
    return spark.read.parquet(f"{path}/{name}").join(small(done, BROADCAST_SESSIONS), "session_id", "left_semi")


def upsert_dim(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of a dimension with those of ``new`` in place of old ones; of several new ones the last by all columns."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    rest = [F.col(c).desc_nulls_last() for c in new.columns if c != key]
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("_new"), *rest))
    return both.withColumn("_rank", rank).where("_rank = 1").drop("_rank", "_new")


def write_sanitized(redacted: DataFrame, path: str, profile: str = "standard") -> None:
    """Redacted texts, and the manifest: each file's hashes, status, reason, replacements; and a summary by export and kind.

    ``redacted`` has export, path, source_sha256, status, reason, text (null where excluded) and replacements. The export
    appears at ``path`` when it is complete; what exists there is refused.
    """
    spark = redacted.sparkSession
    if exists(spark, path):
        raise ValueError(f"output path already exists: {path}")
    staging = f"{path.rstrip('/')}.partial-{uuid.uuid4().hex}"
    try:
        redacted.withColumn("output_sha256", F.sha2(F.col("text").cast("binary"), 256)).write.parquet(f"{staging}/artifacts")
        files = spark.read.parquet(f"{staging}/artifacts")
        manifest = files.select("export", "path", "source_sha256", "output_sha256", "status", "reason", "replacements", F.lit(profile).alias("profile"), F.lit(P.SCHEMA_VERSION).alias("schema_version"))
        manifest.repartitionByRange("export", "path").sortWithinPartitions("export", "path").write.json(f"{staging}/manifest")
        kinds = files.select("export", F.explode("replacements").alias("kind", "n")).groupBy("export", "kind").agg(F.sum("n").alias("replacements"))
        kinds.write.json(f"{staging}/summary")
        publish(spark, staging, path)
    except BaseException:
        remove(spark, staging)
        raise


def report_payload(findings: DataFrame, timeline: DataFrame, manifest: DataFrame | None = None, sensitive: DataFrame | None = None, most: int = 1000) -> DataFrame:
    """One coded JSON document for each bundle: its manifest, gravest findings, first events and sensitive counts.

    At most ``most`` rows of a table go into a document, in the table's order.
    """

    def head(df: DataFrame, name: str) -> DataFrame:
        rank = F.row_number().over(Window.partitionBy("bundle_id").orderBy(*_order(name, df.columns)[1:]))
        kept = df.withColumn("_rank", rank).where(F.col("_rank") <= most)
        each = F.struct("_rank", F.struct(*[F.col(f"`{c}`") for c in df.columns if c != "bundle_id"]).alias("v"))
        return kept.groupBy("bundle_id").agg(F.transform(F.sort_array(F.collect_list(each)), lambda x: x["v"]).alias(name))

    out = head(findings, "findings").join(head(timeline, "timeline"), "bundle_id", "full_outer")
    names = ["findings", "timeline"]
    if sensitive is not None:
        out, names = out.join(head(sensitive, "sensitive"), "bundle_id", "full_outer"), [*names, "sensitive"]
    if manifest is not None:
        own = manifest.select("bundle_id", F.struct(*[F.col(c) for c in manifest.columns if c != "bundle_id"]).alias("manifest"))
        out, names = out.join(own, "bundle_id", "full_outer"), ["manifest", *names]
    return out.select("bundle_id", F.base64(F.to_json(F.struct(*names)).cast("binary")).alias("payload"))


# The fields of a rule of a rule pack with their least lengths, and its confidences.
RULE_FIELDS = {"id": 2, "title": 3, "category": 2, "severity": 1, "pattern": 1, "confidence": 1}
CONFIDENCES = ["strong", "moderate", "weak"]


def load_rule_pack(text: str, ignore_case: bool = True) -> list[tuple]:
    """Rules of a JSON rule pack in the form of the built-in ones; ValueError says what is wrong with the pack.

    A pack has a version ("1"), a name and rules; a rule has RULE_FIELDS and nothing else.
    """
    pack = json.loads(text)
    if set(pack) - {"$schema"} != {"version", "name", "rules"} or pack["version"] != "1" or not re.fullmatch(r"[a-z0-9][a-z0-9-]+", str(pack["name"])):
        raise ValueError("a rule pack has version 1, a name and rules")
    out = []
    for r in pack["rules"]:
        rule = str(r.get("id", ""))
        if not re.fullmatch(r"[A-Z][A-Z0-9_]+", rule):
            raise ValueError(f"bad rule id {rule!r}")
        if r.keys() != RULE_FIELDS.keys():
            raise ValueError(f"{rule}: a rule has {', '.join(RULE_FIELDS)}")
        for name, least in RULE_FIELDS.items():
            if not isinstance(r[name], str) or len(r[name]) < least:
                raise ValueError(f"{rule}: bad {name}")
        if r["severity"] not in P.SEVERITIES:
            raise ValueError(f"{rule}: bad severity")
        if r["confidence"] not in CONFIDENCES:
            raise ValueError(f"{rule}: bad confidence")
        out.append((rule, r["title"], r["severity"], r["category"], ("(?i)" if ignore_case else "") + r["pattern"], r["confidence"]))
    return out
