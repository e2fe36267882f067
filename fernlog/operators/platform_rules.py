"""Web and PHP logs, JVM dumps and collector logs, Windows events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fernlog import patterns as P
from fernlog.functions import scalars as S
from fernlog.operators.logs import K, limit_lines, match_rules
from fernlog.patterns import java


def _summary(kind: str, n: str = "occurrences"):
    """Text of a finding: before and after the number, or without one."""
    before, after = P.OTHER_SUMMARIES[kind]
    return F.concat(F.lit(before), F.col(n), F.lit(after)) if before else F.lit(after)


def web_findings(lines: DataFrame, least_5xx: int = 5) -> DataFrame:
    """Rules of web and PHP logs by file, and repeated 5xx status lines."""
    lines = limit_lines(lines)
    rules = [(r, t, s, "web", p) for r, s, t, p in P.WEB_RULES]
    pick = lambda i: F.element_at(F.array(*[F.lit(r[i]) for r in rules]), F.col("rule_no") + 1)
    found = match_rules(lines, rules).groupBy(*K, "rule_no").agg(F.count("*").alias("occurrences"), F.min("line_no").alias("line_start"), F.min_by(F.trim("line"), "line_no").alias("excerpt"))
    found = found.select(*K, pick(0).alias("rule_id"), pick(2).alias("severity"), pick(1).alias("title"), "occurrences", "line_start", S.cut_bytes(F.col("excerpt"), 300).alias("excerpt"))
    many = lines.where(F.col("line").rlike(java(P.HTTP_5XX))).groupBy(*K).agg(F.count("*").alias("occurrences")).where(F.col("occurrences") >= least_5xx)
    fixed = [F.lit("WEB_REPEATED_5XX").alias("rule_id"), F.lit("medium").alias("severity"), F.lit("Repeated HTTP 5xx responses").alias("title"), "occurrences", F.lit(1).cast("long").alias("line_start"), F.lit("Repeated HTTP 5xx status records").alias("excerpt")]
    return found.unionByName(many.select(*K, *fixed)).withColumns({"summary": _summary("web"), "confidence": F.lit("strong")})


def thread_states(lines: DataFrame) -> DataFrame:
    """Threads of a dump by state, the first of each line."""
    state = S.extract(F.col("line"), P.THREAD_STATE)
    return limit_lines(lines).select(*K, state.alias("state")).where(F.col("state").isNotNull()).groupBy(*K, "state").agg(F.count("*").alias("threads"))


def gc_pauses(lines: DataFrame, ms: float = 1000.0) -> DataFrame:
    """Lines of a file whose first pause is longer than ``ms``; files without any have none."""
    pause = S.extract(F.col("line"), P.GC_PAUSE).cast("double")
    return limit_lines(lines).where(pause > ms).groupBy(*K).agg(F.count("*").alias("long_pauses"))


def jvm_findings(lines: DataFrame) -> DataFrame:
    """Deadlock, memory exhaustion, blocked threads and long pauses of each file, from one pass of flags and counts."""
    low = F.lower("line")
    first = lambda needle: F.coalesce(F.min(F.when(low.contains(needle), F.col("line_no"))), F.lit(0))
    by = limit_lines(lines).groupBy(*K).agg(
        F.max(low.contains("found one java-level deadlock")).alias("one"),
        F.max(low.contains("found a total of")).alias("total"),
        F.max(low.contains("deadlock")).alias("dead"),
        first("deadlock").alias("dead_line"),
        F.max(low.contains("outofmemoryerror")).alias("oom"),
        first("outofmemoryerror").alias("oom_line"),
        F.count_if(S.extract(F.col("line"), P.THREAD_STATE) == "BLOCKED").alias("blocked"),
        F.count_if(S.extract(F.col("line"), P.GC_PAUSE).cast("double") > 1000.0).alias("pauses"),
    )
    zero = F.lit(0).cast("long")
    rows = [
        ("JVM_DEADLOCK_INDICATOR", "critical", F.col("one") | (F.col("total") & F.col("dead")), F.col("dead_line"), F.lit(1)),
        ("JVM_OUT_OF_MEMORY", "high", F.col("oom"), F.col("oom_line"), F.lit(1)),
        ("JVM_BLOCKED_THREADS", "medium", F.col("blocked") >= 3, zero, F.col("blocked")),
        ("JVM_LONG_GC_PAUSE", "high", F.col("pauses") > 0, zero, F.col("pauses")),
    ]
    each = F.array(*[F.struct(F.lit(r).alias("rule_id"), F.lit(s).alias("severity"), ok.alias("ok"), line.cast("long").alias("line_start"), n.cast("long").alias("occurrences")) for r, s, ok, line, n in rows])
    return _described(by.select(*K, F.inline(each)).where("ok").drop("ok"))


def _described(found: DataFrame) -> DataFrame:
    """Adds title, summary, confidence and excerpt of JVM rules."""
    by_rule = lambda values: F.element_at(F.create_map(*[x for r, v in values.items() for x in (F.lit(r), v)]), F.col("rule_id"))
    texts = {
        "title": by_rule({r: F.lit(t) for r, (t, _) in P.JVM_TEXTS.items()}),
        "summary": by_rule({r: _summary(r) for r in P.JVM_TEXTS}),
        "confidence": F.lit("strong"),
        "excerpt": by_rule({r: F.lit(e) for r, (_, e) in P.JVM_TEXTS.items()}),
    }
    return found.withColumns(texts)


def heap_dumps(inventory: DataFrame) -> DataFrame:
    """A note for each heap dump, which is recognised but not read."""
    dumps = inventory.where(F.col("type").isin("recognized-large-binary-artifact", "jvm-heap-dump"))
    return _described(dumps.select("bundle_id", F.col("path").alias("artifact"), F.lit("JVM_HEAP_DUMP_RECOGNIZED").alias("rule_id"), F.lit("info").alias("severity"), F.lit(0).cast("long").alias("line_start"), F.lit(1).cast("long").alias("occurrences")))


def windows_findings(events: DataFrame) -> DataFrame:
    """Known events by file and id: count and first message. ``events`` has K, position, event_id, message.

    The list of known ids is a constant of the library, and so broadcast.
    """
    spark = events.sparkSession
    known = spark.createDataFrame(P.WINDOWS_EVENTS, "event_id int, rule_id string, severity string, title string")
    found = events.join(F.broadcast(known), "event_id")
    by = found.groupBy(*K, "event_id", "rule_id", "severity", "title").agg(F.count("*").alias("occurrences"), F.min_by("message", "position").alias("m"))
    short = F.when(F.char_length("m") > 300, F.concat(F.substring("m", 1, 300), F.lit("…"))).otherwise(F.col("m"))
    out = by.select(*K, "event_id", "rule_id", "severity", "title", "occurrences", short.alias("excerpt"))
    return out.withColumns({"summary": _summary("windows"), "confidence": F.lit("moderate"), "json_pointer": F.lit("/Events")})
