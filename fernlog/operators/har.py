"""HTTP archives: one row for each request, summaries, findings, timeline, privacy.

``entries`` has bundle_id, artifact, entry, started, time_ms, method, url, status, body_size, content_size, and for privacy
``headers`` (array of name and value) and ``has_body``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fernlog import patterns as P
from fernlog.functions import scalars as S
from fernlog.operators.logs import K, count_of

SLOW_MS = 2000


def har_summary(entries: DataFrame, inventory: DataFrame | None = None) -> DataFrame:
    """Requests, bytes, 4xx, 5xx, redirects and slow requests of each file; zeros for files of ``inventory`` without entries."""
    size = F.when(F.col("body_size") > 0, F.col("body_size")).when(F.col("content_size") > 0, F.col("content_size")).otherwise(0)
    s = F.col("status")
    out = entries.groupBy(*K).agg(
        F.count("*").alias("requests"),
        F.sum(size).alias("bytes"),
        F.count_if((s >= 400) & (s < 500)).alias("http4xx"),
        F.count_if(s >= 500).alias("http5xx"),
        F.count_if((s >= 300) & (s < 400)).alias("redirects"),
        F.count_if(F.col("time_ms") >= SLOW_MS).alias("slow"),
    )
    if inventory is None:
        return out
    return inventory.select(*K).join(out, K, "left").na.fill(0)


def har_domains(entries: DataFrame) -> DataFrame:
    """Requests by host; URLs without a host are left out."""
    hosts = entries.select(*K, S.url_host(F.col("url")).alias("host")).where("host != 'unknown'")
    return hosts.groupBy(*K, "host").agg(F.count("*").alias("requests"))


def har_privacy(entries: DataFrame, kinds: list[tuple[str, str]] = P.STRICT_KINDS) -> DataFrame:
    """Sensitive header names, matches in header values and URLs, and requests with a body or cookies, by file and kind."""
    names = ["authorization", "cookie", "set-cookie", "x-api-key"]

    def named(n):
        return F.size(F.filter("headers", lambda h: F.lower(h["name"]) == n)).alias(n)

    def of_headers(k, p):
        return F.aggregate("headers", F.lit(0), lambda acc, h: acc + count_of(h["value"], k, p))

    of_name = [named(n) for n in names]
    of_kind = [(of_headers(k, p) + count_of(F.col("url"), k, p)).alias(k) for k, p in kinds]
    columns = [*names, *[k for k, _ in kinds], "request_or_cookie_body"]
    rows = entries.select(*K, *of_name, *of_kind, F.col("has_body").cast("int").alias("request_or_cookie_body"))
    each = F.array(*[F.struct(F.lit(c).alias("kind"), F.col(f"`{c}`").alias("n")) for c in columns])
    some = rows.select(*K, F.inline(F.filter(each, lambda x: x["n"] > 0)))
    return some.groupBy(*K, "kind").agg(F.sum("n").alias("matches"))


def har_findings(summary: DataFrame) -> DataFrame:
    """Findings of each file: server errors, client errors, slow requests, where there are any."""
    rules = [(*r, n) for r, n in zip(P.HAR_RULES, ("http5xx", "http4xx", "slow"), strict=True)]
    each = F.array(*[F.struct(F.lit(r).alias("rule_id"), F.lit(t).alias("title"), F.lit(s).alias("severity"), F.lit(c).alias("category"), F.col(n).alias("occurrences")) for r, t, s, c, n in rules])
    out = summary.select(*K, *[c for c in ("sha256",) if c in summary.columns], F.inline(each)).where("occurrences > 0")
    text = F.format_string("Observed %d matching request(s) in %s.", "occurrences", "artifact")
    return out.withColumns({"summary": text, "confidence": F.lit("exact"), "json_pointer": F.lit("/log/entries")})


def har_timeline(entries: DataFrame) -> DataFrame:
    """An event for each entry whose start is an RFC 3339 time."""
    s = F.col("status")
    severity = F.when(s >= 500, "error").when((s >= 400) | (F.col("time_ms") >= SLOW_MS), "warning").otherwise("info")
    ms = F.bround("time_ms", 0).cast("long")
    message = F.concat(F.col("method"), F.lit(" "), S.safe_url(F.col("url")), F.lit(" returned "), s, F.lit(" in "), ms, F.lit(" ms"))
    times = [c for c in ("status", "time_ms", "ttfb_ms") if c in entries.columns]
    out = entries.select(*K, *times, "entry", S.parse_ts_har(F.col("started")).alias("ts"), F.lit("har").alias("source"), S.url_host(F.col("url")).alias("component"), severity.alias("severity"), F.lit("http-request").alias("category"), message.alias("message"), F.concat(F.lit("/log/entries/"), F.col("entry")).alias("json_pointer"))
    return out.where(F.col("ts").isNotNull())
