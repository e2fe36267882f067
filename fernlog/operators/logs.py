"""Application logs: parsing in two dialects, findings by rule, timeline, privacy counts.

``lines`` has bundle_id, artifact, line_no, line. K stands for (bundle_id, artifact).
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fernlog import patterns as P
from fernlog.functions import scalars as S
from fernlog.patterns import java
from fernlog.storage import stored

K = ["bundle_id", "artifact"]
#: Bytes of a line with which its file can't be read.
LONGEST = 1 << 20
#: Severities of the timeline.
_SEVERE = ("warning", "error", "critical")


def _variant():
    """The line as a JSON object, or null: only lines in braces are parsed."""
    return F.when(F.col("line").rlike(r"^[\t\n\r ]*\{[\s\S]*\}[\t\n\r ]*$"), F.try_parse_json("line"))


def parse_log_a(lines: DataFrame, tz: str = "UTC") -> DataFrame:
    """Adds ts, severity, component, message, correlation_id.

    A JSON object gives them by ordered lists of keys (only strings count); any other line by patterns and key words,
    with component ``unknown``. A null line parses like an empty one. An object with a repeated key counts as text.
    """
    seen = _worked_out(lines.withColumn("_v", _variant()))
    return seen.select(*lines.columns, *[c.alias(k) for k, c in _fields_a(tz).items()])


def _fields_a(tz: str) -> dict[str, Column]:
    """Columns of dialect A, from ``line`` and its variant ``_v``."""
    v = F.col("_v")
    text = F.coalesce("line", F.lit(""))
    raw = F.when(v.isNotNull(), S.first_string(v, P.A_TIME)).otherwise(S.extract(text, P.TIMESTAMP, 0))
    severity = F.when(v.isNotNull(), S.norm_severity_a(F.coalesce(S.first_string(v, P.A_LEVEL), F.lit("")))).otherwise(S.detect_severity(text))
    component = F.when(v.isNotNull(), S.first_string(v, P.A_COMPONENT))
    message = F.when(v.isNotNull(), S.first_string(v, P.MESSAGE))
    cid = F.when(v.isNotNull(), S.first_string(v, P.A_ID)).otherwise(S.correlation_id(text))
    full = lambda c, other: F.coalesce(F.when(c != "", c), other)
    return {
        "ts": S.parse_ts_a(raw, tz),
        "severity": full(severity, F.lit("info")),
        "component": full(component, F.lit("unknown")),
        "message": full(message, text),
        "correlation_id": full(cid, F.lit(None)),
    }


def parse_log_b(lines: DataFrame) -> DataFrame:
    """Adds malformed, ts, level, service, message, correlation_id in the second dialect: a time, a level word, ``service=`` and
    an id anywhere.

    Bytes that are no UTF-8 are replaced. A line that holds a NUL is malformed: nothing is read from it (level and message
    are null), and it counts only as a line.
    """
    lines = split_malformed(lines.withColumn("line", F.make_valid_utf8("line")))
    v = F.col("_v")
    text = F.when(~F.col("malformed"), F.coalesce("line", F.lit("")))
    raw = F.when(v.isNotNull(), S.first_string(v, P.B_TIME)).otherwise(S.extract(text, P.TIMESTAMP, 0))
    level = F.when(v.isNotNull(), S.first_string(v, P.B_LEVELS)).otherwise(S.extract(text, P.B_LEVEL))
    service = F.when(v.isNotNull(), S.first_string(v, P.B_COMPONENT)).otherwise(S.extract(text, P.B_SERVICE))
    message = F.when(v.isNotNull(), S.first_string(v, P.MESSAGE))
    cid = F.when(v.isNotNull(), S.first_string(v, P.B_ID)).otherwise(S.correlation_id_b(text))
    full = lambda c, other: F.coalesce(F.when(c != "", c), other)
    return _worked_out(lines.withColumn("_v", F.when(~F.col("malformed"), _variant()))).select(
        *lines.columns,
        S.parse_ts_b(raw).alias("ts"),
        F.when(~F.col("malformed"), S.norm_level_b(F.coalesce(level, F.lit("")))).alias("level"),
        full(service, F.lit("unknown")).alias("service"),
        full(message, text).alias("message"),
        full(cid, F.lit(None)).alias("correlation_id"),
    )


def split_malformed(lines: DataFrame) -> DataFrame:
    """Adds ``malformed``: true for lines that hold a NUL."""
    return lines.withColumn("malformed", F.coalesce(F.contains("line", F.lit("\0")), F.lit(False)))


def match_rules(lines: DataFrame, rules: list[tuple] = P.LOG_RULES) -> DataFrame:
    """One row for each line and rule that it matches."""
    return lines.withColumn("rule_no", F.explode(S.matching(F.col("line"), [r[4] for r in rules])))


def log_findings(lines: DataFrame, rules: list[tuple] = P.LOG_RULES) -> DataFrame:
    """Findings by (K, rule, component, fingerprint): counts, first and last line, first excerpt.

    A rule is (id, title, severity, category, pattern) and maybe a confidence, else ``strong``. Sums are taken before the
    shuffle, so that a line repeated billions of times is one row of it. ``lines`` may have sha256, the artifact's hash,
    which then goes with the findings.
    """
    found = match_rules(lines, rules).transform(parse_log_a)
    return group_findings(found.withColumns({"fingerprint": S.fingerprint(F.col("line")), "excerpt": S.excerpt(F.col("line"))}), rules)


def group_findings(found: DataFrame, rules: list[tuple] = P.LOG_RULES) -> DataFrame:
    """Findings of matched lines: K, line_no, rule_no, component, fingerprint, excerpt, and maybe sha256."""
    pick = lambda i, other=None: F.element_at(F.array(*[F.lit(r[i] if i < len(r) else other) for r in rules]), F.col("rule_no") + 1)
    more = ["sha256"] if "sha256" in found.columns else []
    grouped = found.groupBy(*K, *more, "rule_no", "component", "fingerprint").agg(
        F.count("*").alias("occurrences"), F.min("line_no").alias("line_start"), F.max("line_no").alias("line_end"), F.min_by("excerpt", "line_no").alias("excerpt")
    )
    summary = F.format_string("Observed %d matching event(s) in %s between lines %d and %d.", "occurrences", "artifact", "line_start", "line_end")
    return grouped.select(*K, *more, pick(0).alias("rule_id"), pick(1).alias("title"), pick(2).alias("severity"), pick(3).alias("category"), "component", "fingerprint", "occurrences", "line_start", "line_end", "excerpt", summary.alias("summary"), pick(5, "strong").alias("confidence"))


def with_ids(findings: DataFrame) -> DataFrame:
    """Adds the stable id of (artifact's sha256, rule) and, where there is one, the fingerprint."""
    return findings.withColumn("id", S.finding_id(F.col("sha256"), F.col("rule_id"), F.col("fingerprint")))


FULL = ["bundle_id", "id", "rule_id", "title", "severity", "category", "component", "summary", "explanation", "confidence", "evidence", "next_steps", "references", "occurrences"]


def full_findings(findings: DataFrame, category: str | None = None) -> DataFrame:
    """Findings of any analyzer in the form in which they are stored: the columns FULL.

    Explanation and next steps follow the rule. Evidence is an array of (artifact, line_start, line_end, json_pointer,
    timestamp, excerpt), empty where none of these is known; a line of 0 stands for none. Columns that an analyzer doesn't have are null or empty.
    """
    has = lambda c, kind: F.col(c).cast(kind) if c in findings.columns else F.lit(None).cast(kind)
    line = lambda c: F.when(has(c, "bigint") > 0, has(c, "bigint"))
    texts = F.create_map(*[F.lit(x) for kv in P.EXPLANATIONS.items() for x in kv])
    har = {r: P.HAR_STEPS for r in P.EXPLANATIONS if r.startswith("HAR_")}
    steps = F.create_map(*[x for r, s in (P.NEXT_STEPS | har).items() for x in (F.lit(r), F.array(*map(F.lit, s)))])
    one = F.struct(
        F.col("artifact"), line("line_start").alias("line_start"), line("line_end").alias("line_end"), has("json_pointer", "string").alias("json_pointer"), F.lit(None).cast("string").alias("timestamp"), has("excerpt", "string").alias("excerpt")
    )
    none = F.array().cast("array<string>")
    columns = {
        "id": has("id", "string"),
        "category": F.coalesce(has("category", "string"), F.lit(category or "")),
        "component": F.coalesce(has("component", "string"), F.lit("")),
        "explanation": F.coalesce(F.try_element_at(texts, F.col("rule_id")), F.lit("")),
        "evidence": F.filter(F.array(one), lambda e: e["line_start"].isNotNull() | e["json_pointer"].isNotNull() | e["excerpt"].isNotNull()),
        "next_steps": F.coalesce(F.try_element_at(steps, F.col("rule_id")), none),
        "references": none,
        "occurrences": F.col("occurrences").cast("bigint"),
    }
    return findings.select(*[columns[c].alias(c) if c in columns else c for c in FULL])


def log_timeline(parsed: DataFrame) -> DataFrame:
    """Events of the timeline: rows with a time and severity warning, error or critical."""
    # the severity is the cheaper test
    kept = parsed.where(F.col("severity").isin(*_SEVERE) & F.col("ts").isNotNull())
    return kept.select(*K, "line_no", "ts", F.lit("log").alias("source"), "component", "severity", F.lit("application-log").alias("category"), S.excerpt(F.col("message")).alias("message"), "correlation_id")


def line_facts(lines: DataFrame, rules: list[tuple] = P.LOG_RULES, tz: str = "UTC", most: int = LONGEST) -> DataFrame:
    """All that the log analyses take from a line, from one look at it; most lines give none and have no row.

    K, sha256 (if there is one), line_no, rules (numbers of the rules it matches), component, fingerprint, excerpt (where it matches one),
    ts, severity, message, correlation_id (where it is an event), counts (kind, n: sensitive data), failed (it has ``most`` bytes or more,
    and its file can't be read). ``findings_of``, ``timeline_of``, ``sensitive_of`` and ``failed_of`` make the tables from it.
    """
    more = ["sha256"] if "sha256" in lines.columns else []
    own, text, n = _fields_a(tz), F.col("line"), len(rules)
    # rules and kinds of sensitive data in one go: only the kinds that are there are counted
    found = lines.select(*K, *more, "line_no", "line", S.matching(text, [*(r[4] for r in rules), *(p for _, p in P.STRICT_KINDS)]).alias("_found"))
    kinds = [F.when(F.array_contains("_found", n + i), F.regexp_count(text, F.lit(java(p)))) for i, (_, p) in enumerate(P.STRICT_KINDS)]
    counts = F.array_compact(F.array(*[F.when(c > 0, F.struct(F.lit(k).alias("kind"), c.alias("n"))) for (k, _), c in zip(P.STRICT_KINDS, kinds, strict=True)]))
    counts = F.when(F.exists("_found", lambda k: k >= n), counts).otherwise(F.array().cast("array<struct<kind string, n int>>"))
    failed = F.coalesce(F.octet_length("line") >= most, F.lit(False))
    seen = _worked_out(found.withColumn("_v", _variant()))
    seen = _worked_out(seen.select(*K, *more, "line_no", "line", "_v", F.filter("_found", lambda k: k < n).alias("rules"), own["severity"].isin(*_SEVERE).alias("_severe"), counts.alias("counts"), failed.alias("failed")))
    hit, ts = F.size("rules") > 0, F.when(F.col("_severe"), own["ts"])
    seen = seen.where(hit | F.col("_severe") | (F.size("counts") > 0) | F.col("failed"))
    facts = _worked_out(seen.select("*", ts.alias("ts")))
    event = F.col("ts").isNotNull()
    return facts.where(hit | event | (F.size("counts") > 0) | F.col("failed")).select(
        *K, *more, "line_no", "rules", F.when(hit | event, own["component"]).alias("component"), F.when(hit, S.fingerprint(text)).alias("fingerprint"), F.when(hit, S.excerpt(text)).alias("excerpt"),
        "ts", F.when(event, own["severity"]).alias("severity"), F.when(event, S.excerpt(own["message"])).alias("message"), F.when(event, own["correlation_id"]).alias("correlation_id"), "counts", "failed",
    )


def _worked_out(df: DataFrame) -> DataFrame:
    """The same rows through a generator: what stands above uses the columns instead of working them out again, as filters that are pushed
    through a projection do."""
    return df.select(F.explode(F.array(F.struct(*df.columns))).alias("f")).select("f.*")


def findings_of(facts: DataFrame, rules: list[tuple] = P.LOG_RULES) -> DataFrame:
    """``log_findings`` of the lines behind ``facts``."""
    return group_findings(facts.where(F.size("rules") > 0).withColumn("rule_no", F.explode("rules")), rules)


def timeline_of(facts: DataFrame) -> DataFrame:
    """``log_timeline`` of the lines behind ``facts``."""
    return facts.where(F.col("ts").isNotNull()).select(*K, "line_no", "ts", F.lit("log").alias("source"), "component", "severity", F.lit("application-log").alias("category"), "message", "correlation_id")


def sensitive_of(facts: DataFrame) -> DataFrame:
    """``privacy_counts`` by file of the lines behind ``facts``."""
    return facts.select(*K, F.inline("counts")).groupBy(*K, "kind").agg(F.sum("n").alias("matches"))


def failed_of(facts: DataFrame) -> DataFrame:
    """``failed_files`` of the lines behind ``facts``."""
    return facts.where("failed").select(*K).distinct().withColumn("warning", F.lit(P.LONG_LINE))


def cap_timeline(timeline: DataFrame, n: int = 100_000) -> DataFrame:
    """The first n events of each file by line. Spark limits each task's rows before the shuffle."""
    rank = F.row_number().over(Window.partitionBy(*K).orderBy("line_no"))
    return timeline.withColumn("_rank", rank).where(F.col("_rank") <= n).drop("_rank")


def cap_findings(findings: DataFrame, n: int = 10_000, order: tuple = ("artifact", "rule_id", "component", "fingerprint")) -> DataFrame:
    """The first n findings of each bundle by ``order`` (path, rule, component and fingerprint), before any sort by severity."""
    rank = F.row_number().over(Window.partitionBy("bundle_id").orderBy(*order))
    return findings.withColumn("_rank", rank).where(F.col("_rank") <= n).drop("_rank")


def limit_lines(lines: DataFrame, n: int = 2_000_000) -> DataFrame:
    """The first n lines of each file."""
    return lines.where(F.col("line_no") <= n)


def detect_counts(text, kinds: list[tuple[str, str]] = P.STRICT_KINDS) -> list:
    """One count column for each kind; kinds are counted independently of one another."""
    return [count_of(text, k, p).alias(k) for k, p in kinds]


def may_hold(text, kind: str):
    """Whether a text may hold a match of a kind at all, by a test that is cheaper than its pattern; None if there is none."""
    tests = [F.contains(text, F.lit(n)) for n in P.NEEDLES.get(kind, [])] + [F.contains(F.lower(text), F.lit(n)) for n in P.LOW_NEEDLES.get(kind, [])]
    if kind in P.HINTS:
        tests.append(F.regexp_like(text, F.lit(P.HINTS[kind])))
    return functools.reduce(lambda a, b: a | b, tests) if tests else None


def count_of(text, kind: str, pattern: str):
    """Matches of a kind in a text; 0 for null."""
    n = F.coalesce(F.regexp_count(text, F.lit(java(pattern))), F.lit(0))
    may = may_hold(text, kind)
    return n if may is None else F.when(may, n).otherwise(0)


def privacy_counts(rows: DataFrame, text: str, keys: list[str], kinds: list[tuple[str, str]] = P.STRICT_KINDS, nul_hides: bool = False) -> DataFrame:
    """Matches by ``keys`` and kind, without zeros. With ``nul_hides`` a file that holds a NUL or a line of 1 MiB anywhere has no rows.

    A row gives one pair for each kind that it matches, which most rows do not; pairs are summed before the shuffle.
    """
    counts = detect_counts(F.col(text), kinds)
    each = F.array(*[F.struct(F.lit(k).alias("kind"), c.alias("n")) for (k, _), c in zip(kinds, counts, strict=True)])
    found = rows.select(*keys, F.inline(F.filter(each, lambda x: x["n"] > 0)))
    out = found.groupBy(*keys, "kind").agg(F.sum("n").alias("matches"))
    if nul_hides:
        hidden = rows.where(F.contains(F.col(text), F.lit("\0")) | (F.octet_length(text) >= LONGEST)).select(*keys).distinct()
        out = out.join(hidden, keys, "left_anti")
    return out


def sort_findings(findings: DataFrame) -> DataFrame:
    """Most severe first, then by id or, without one, by the finding's key."""
    rest = ["id"] if "id" in findings.columns else [c for c in (*K, "rule_id", "component", "fingerprint") if c in findings.columns]
    return findings.orderBy(S.severity_rank(F.col("severity")).desc(), *rest)


def sort_timeline(timeline: DataFrame) -> DataFrame:
    """By time, then artifact, then line.

    A sort into ranges looks at its input twice; the events are stored first, so that lines are parsed once.
    """
    return stored(timeline, "timeline").orderBy("ts", "artifact", "line_no")


def failed_files(lines: DataFrame, most: int = LONGEST) -> DataFrame:
    """Files with a line of ``most`` bytes or more: K and a warning. Nothing is read from such a file."""
    return lines.where(F.octet_length("line") >= most).select(*K).distinct().withColumn("warning", F.lit(P.LONG_LINE))


def union_findings(*found: DataFrame) -> DataFrame:
    """Findings of all analyzers in one table; columns that one lacks are null."""
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def fleet_patterns(findings: DataFrame) -> DataFrame:
    """The same patterns over all bundles: occurrences and number of bundles by (rule, fingerprint)."""
    by = findings.groupBy("rule_id", "fingerprint", "bundle_id").agg(F.sum("occurrences").alias("n"))
    return by.groupBy("rule_id", "fingerprint").agg(F.sum("n").alias("occurrences"), F.count("*").alias("bundles"))
