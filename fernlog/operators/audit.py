"""Data-quality audits of stored tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fernlog import patterns as P


def check_constraints(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Rows that break each named rule, in one pass: rule, checked, broken. A rule that is null for a row holds."""
    names = list(rules)
    counts = df.agg(F.count("*").alias("checked"), *[F.count_if(~F.coalesce(rules[n], F.lit(True))).alias(n) for n in names])
    return counts.unpivot(["checked"], [f"`{n}`" for n in names], "rule", "broken").select(F.replace("rule", F.lit("`"), F.lit("")).alias("rule"), "checked", "broken")


def artifact_rules() -> dict[str, Column]:
    return {
        "sha256_format": F.col("sha256").rlike("^[0-9a-f]{64}$"),
        "size_not_negative": F.col("size") >= 0,
        "path_relative": ~F.col("path").startswith("/") & ~F.col("path").rlike(r"(^|/)\.\.(/|$)"),
        "type_present": F.col("type").isNotNull() & (F.col("type") != ""),
    }


def finding_rules() -> dict[str, Column]:
    return {
        "severity_known": F.col("severity").isin(P.SEVERITIES),
        "confidence_in_schema": F.col("confidence").isin("exact", "strong", "heuristic"),
        "confidence_in_store": F.col("confidence").isin("strong", "moderate", "weak"),
        "rule_id_format": F.col("rule_id").rlike("^[A-Z][A-Z0-9_]+$"),
        "occurrences_positive": F.col("occurrences") >= 1,
        "lines_in_order": F.col("line_end") >= F.col("line_start"),
        "excerpt_short": F.char_length("excerpt") <= 4096,
    }


def timeline_rules() -> dict[str, Column]:
    return {"severity_known": F.col("severity").isin(P.TIMELINE_SEVERITIES), "time_present": F.col("ts").isNotNull(), "line_positive": F.col("line_no") >= 1}


def _present(*columns: str) -> dict[str, Column]:
    return {f"{c}_present": F.col(c).isNotNull() & (F.col(c).cast("string") != "") for c in columns}


def workspace_rules() -> dict[str, dict[str, Column]]:
    """All rules of the record schemas and of the store, by table of a workspace; a null counts as broken where a value is required."""
    each = lambda rule: F.forall("evidence", lambda e: F.coalesce(rule(e), F.lit(True)))
    return {
        "artifacts": _present("id", "path") | {"type_format": F.coalesce(F.col("type").rlike("^[a-z0-9][a-z0-9-]{1,63}$"), F.lit(False)), **{k: F.coalesce(v, F.lit(False)) for k, v in artifact_rules().items() if k != "type_present"}},
        "findings": _present("id", "title", "category", "summary")
        | {
            "rule_id_format": F.coalesce(F.col("rule_id").rlike("^[A-Z0-9_]+$"), F.lit(False)),
            "severity_known": F.coalesce(F.col("severity").isin(P.SEVERITIES), F.lit(False)),
            "confidence_in_schema": F.coalesce(F.col("confidence").isin("exact", "strong", "heuristic"), F.lit(False)),
            "confidence_in_store": F.coalesce(F.col("confidence").isin("strong", "moderate", "weak"), F.lit(False)),
            "occurrences_positive": F.coalesce(F.col("occurrences") > 0, F.lit(False)),
            "evidence_present": F.coalesce(F.size("evidence") >= 1, F.lit(False)),
            "evidence_artifact": F.forall("evidence", lambda e: e["artifact"].isNotNull()),
            "evidence_lines": each(lambda e: (e["line_start"] >= 1) & (e["line_end"].isNull() | (e["line_end"] >= e["line_start"]))),
            "excerpt_short": each(lambda e: F.char_length(e["excerpt"]) <= 4096),
            "next_steps_present": F.col("next_steps").isNotNull(),
        },
        "timeline": _present("ts", "source", "component", "category", "artifact") | {"severity_known": F.coalesce(F.col("severity").isin(P.TIMELINE_SEVERITIES), F.lit(False)), "message_present": F.col("message").isNotNull(), "evidence_present": F.col("evidence").isNotNull()},
        "sensitive": _present("kind") | {"matches_positive": F.coalesce(F.col("matches") > 0, F.lit(False))},
        "runs": _present("name") | {"status_known": F.coalesce(F.col("status").isin(P.RUN_STATUSES), F.lit(False)), "warnings_present": F.col("warnings").isNotNull()},
        "sessions": {"status_known": F.coalesce(F.col("status").isin(P.STORED_STATUSES), F.lit(False)), "times_in_order": F.col("completed_at") >= F.col("started_at"), "warning_count_not_negative": F.col("warning_count") >= 0},
        "pairs": {"sides_differ": F.col("baseline") != F.col("incident")},
        "reports": {"format_known": F.coalesce(F.col("format").isin(P.REPORT_FORMATS), F.lit(False)), "sha256_format": F.coalesce(F.col("sha256").rlike("^[0-9a-f]{64}$"), F.lit(False))},
    }


def audit_workspace(tables: dict[str, DataFrame]) -> DataFrame:
    """Rows that break each rule of each table, one pass a table: table, rule, checked, broken. Tables without rules are passed over."""
    rules = workspace_rules()
    parts = [check_constraints(df, rules[name]).select(F.lit(name).alias("table"), "rule", "checked", "broken") for name, df in tables.items() if name in rules]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def check_schema(df: DataFrame, kind: str) -> DataFrame:
    """Rows against the schema of findings, timeline or artifacts."""
    return check_constraints(df, {"finding": finding_rules, "timeline": timeline_rules, "artifact": artifact_rules}[kind]())


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that more than one row has."""
    return df.groupBy(*keys).agg(F.count("*").alias("rows")).where(F.col("rows") > 1)


def fk_violations(child: DataFrame, parent: DataFrame, key: str, parent_key: str | None = None) -> DataFrame:
    """Rows of the child whose key no row of the parent has; a null key is no violation."""
    keys = parent.select(F.col(parent_key or key).alias("_key")).distinct()
    return child.where(F.col(key).isNotNull()).join(keys, F.col(key) == F.col("_key"), "left_anti")
