"""Interactive queries on stored tables: search, ranges, pages, report cards."""

from __future__ import annotations

import base64
import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fernlog import patterns as P
from fernlog.functions import scalars as S

# English words without weight in a search.
STOP = "a an and are as at be but by for if in into is it no not of on or such that the their then there these they this to was will with".split()
WEIGHTS = {"A": 1.0, "B": 0.4, "C": 0.2}


def search_findings(findings: DataFrame, q: str = "", severity: str | None = None) -> DataFrame:
    """Findings of a severity whose title, summary or component holds q, in any case."""
    out = findings.where(F.col("severity") == severity) if severity else findings
    return out.where(F.lower(F.concat_ws(" ", "title", "summary", "component")).contains(q.lower()))


def search_artifacts(artifacts: DataFrame, q: str) -> DataFrame:
    """Artifacts whose path or type holds q, in any case."""
    return artifacts.where(F.lower(F.concat_ws(" ", "path", "type")).contains(q.lower()))


def timeline_range(events: DataFrame, session: str, start: str, end: str, limit: int = 500) -> DataFrame:
    """The first events of a session from start up to, but without, end. ``events`` has bundle_id, ts, id."""
    own = events.where((F.col("bundle_id") == session) & (F.col("ts") >= F.lit(start).cast("timestamp")) & (F.col("ts") < F.lit(end).cast("timestamp")))
    return own.orderBy("ts", "id").limit(limit)


def by_correlation(events: DataFrame, session: str, cid: str) -> DataFrame:
    return events.where((F.col("bundle_id") == session) & (F.col("correlation_id") == cid))


def findings_by_session(findings: DataFrame, session: str, limit: int = 100) -> DataFrame:
    """The gravest findings of a session. ``findings`` has bundle_id, severity, id."""
    return findings.where(F.col("bundle_id") == session).orderBy(S.severity_rank(F.col("severity")).desc(), "id").limit(limit)


def timeline_head(events: DataFrame, n: int = 1000) -> DataFrame:
    """The first n events of each bundle."""
    rank = F.row_number().over(Window.partitionBy("bundle_id").orderBy("ts", "artifact", "line_no"))
    return events.withColumn("position", rank).where(F.col("position") <= n)


def list_sessions(sessions: DataFrame, limit: int | None = None) -> DataFrame:
    """Sessions, newest first."""
    out = sessions.orderBy(F.desc("created_at"), "session_id")
    return out.limit(limit) if limit else out


def session_metrics(sessions: DataFrame) -> DataFrame:
    """Sessions by the reported statuses; zeros stay."""
    known = sessions.sparkSession.createDataFrame([(s,) for s in P.SESSION_STATUSES], "status string")
    counts = sessions.groupBy(F.col("status").alias("_s")).agg(F.count("*").alias("n"))
    return known.join(counts, F.col("status") == F.col("_s"), "left").select("status", F.coalesce("n", F.lit(0)).alias("sessions"))


def _tokens(col: Column) -> Column:
    found = F.regexp_extract_all(F.lower(F.coalesce(col, F.lit(""))), F.lit("([a-z0-9]+)"), 1)
    return F.filter(found, lambda t: ~t.isin(STOP))


def token_vector(findings: DataFrame) -> DataFrame:
    """Adds ``tokens``: title (A), summary (B), component and rule (C), without stop words and without stemming."""
    return findings.withColumns({"_a": _tokens(F.col("title")), "_b": _tokens(F.col("summary")), "_c": _tokens(F.concat_ws(" ", "component", F.replace("rule_id", F.lit("_"), F.lit(" "))))})


def search_ranked(findings: DataFrame, session: str | None, query: str, limit: int = 50) -> DataFrame:
    """Findings that hold all words of the query, the heaviest first: a word weighs 1.0 in the title, 0.4 in the summary,
    0.2 in component or rule, for each time it stands there."""
    wanted = [w for w in "".join(c if c.isalnum() else " " for c in query.lower()).split() if w not in STOP]
    own = token_vector(findings.where(F.col("bundle_id") == session) if session else findings)
    times = lambda col, w: F.size(F.filter(col, lambda t: t == w))
    rank, ok = F.lit(0.0), F.lit(bool(wanted))
    for w in wanted:
        parts = {k: times(c, w) for k, c in (("A", "_a"), ("B", "_b"), ("C", "_c"))}
        rank = rank + sum((parts[k] * F.lit(WEIGHTS[k]) for k in parts), F.lit(0.0))
        ok = ok & (parts["A"] + parts["B"] + parts["C"] > 0)
    found = own.where(ok).withColumn("rank", F.round(rank, 6)).drop("_a", "_b", "_c")
    return found.orderBy(F.desc("rank"), "id").limit(limit)


def encode_cursor(offset: int) -> str:
    return base64.urlsafe_b64encode(str(offset).encode()).decode().rstrip("=")


def decode_cursor(cursor: str | None) -> int:
    """The offset of a cursor, 0 without one; ValueError for anything else."""
    if not cursor:
        return 0
    text = base64.urlsafe_b64decode(cursor + "=" * (-len(cursor) % 4)).decode()
    if not text.isdigit():
        raise ValueError("bad cursor")
    return int(text)


def page(df: DataFrame, order: list, cursor: str | None = None, limit: int = 50) -> tuple[list, str | None]:
    """Rows of a page (1 to 200) and the next page's cursor, or None at the end."""
    size, offset = max(1, min(200, limit)), decode_cursor(cursor)
    rows = df.orderBy(*order).offset(offset).limit(size + 1).collect()
    return rows[:size], encode_cursor(offset + size) if len(rows) > size else None


def page_after(df: DataFrame, keys: list[str], cursor: str | None = None, limit: int = 50) -> DataFrame:
    """The ``limit`` (1 to 200) rows that come after a cursor in the order of ``keys``, which together are unique and never null.

    The cursor holds the keys of the last row that was seen. So a page costs the same wherever it is, the test of the first key reaches the
    scan, and rows that come or go between two pages neither repeat nor hide others. ValueError for what is no cursor of these keys.
    """
    rows = df
    if cursor:
        values = _key_values(df, keys, cursor)
        after, same = F.lit(False), F.lit(True)
        for k, v in zip(keys, values, strict=True):
            after, same = after | (same & (F.col(k) > v)), same & (F.col(k) == v)
        rows = rows.where((F.col(keys[0]) >= values[0]) & after)
    return rows.orderBy(*keys).limit(max(1, min(200, limit)))


def next_cursor(page: DataFrame, keys: list[str]) -> str | None:
    """The cursor behind a page, whose last row is looked up; None for an empty one. Times are held in microseconds."""
    as_text = [F.unix_micros(k).cast("string") if t == "timestamp" else F.col(k).cast("string") for k, t in _types(page, keys)]
    last = page.orderBy(*[F.desc(k) for k in keys]).select(F.array(*as_text).alias("v")).first()
    return base64.urlsafe_b64encode(json.dumps(last.v).encode()).decode().rstrip("=") if last else None


def _types(df: DataFrame, keys: list[str]) -> list[tuple[str, str]]:
    kinds = dict(df.dtypes)
    return [(k, kinds[k]) for k in keys]


def _key_values(df: DataFrame, keys: list[str], cursor: str) -> list[Column]:
    try:
        held = json.loads(base64.urlsafe_b64decode(cursor + "=" * (-len(cursor) % 4)))
        if not isinstance(held, list) or len(held) != len(keys) or not all(isinstance(v, str) for v in held):
            raise ValueError
        return [F.timestamp_micros(F.lit(int(v))) if t == "timestamp" else F.lit(v).cast(t) for v, (_, t) in zip(held, _types(df, keys), strict=True)]
    except ValueError:
        raise ValueError("bad cursor") from None


def report_summary(artifacts: DataFrame, findings: DataFrame, events: DataFrame, sensitive: DataFrame) -> DataFrame:
    """Cards of each bundle: artifacts, findings, grave findings, events, privacy matches; sums before one small join."""
    grave = F.when(F.col("severity").isin("critical", "high"), 1).otherwise(0)
    zero = F.lit(0).cast("long")
    rows = [
        artifacts.select("bundle_id", F.lit(1).alias("artifacts"), zero.alias("findings"), zero.alias("grave"), zero.alias("events"), zero.alias("matches")),
        findings.select("bundle_id", zero, F.lit(1), grave, zero, zero),
        events.select("bundle_id", zero, zero, zero, F.lit(1), zero),
        sensitive.select("bundle_id", zero, zero, zero, zero, F.col("matches")),
    ]
    out = rows[0]
    for r in rows[1:]:
        out = out.union(r)
    return out.groupBy("bundle_id").agg(*[F.sum(c).alias(c) for c in ("artifacts", "findings", "grave", "events", "matches")])


def evidence_view(findings: DataFrame, artifacts: DataFrame) -> DataFrame:
    """Evidence of findings beside the artifact that it stands in, if that is known."""
    known = artifacts.select(F.col("bundle_id").alias("_b"), F.col("path").alias("_p"), "type", "sha256")
    out = findings.join(known, (F.col("bundle_id") == F.col("_b")) & (F.col("artifact") == F.col("_p")), "left")
    return out.select("bundle_id", "rule_id", "artifact", "line_start", "line_end", "type", "sha256")
