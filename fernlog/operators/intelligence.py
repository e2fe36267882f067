"""Log intelligence: repeated errors, bursts, correlation chains, file summaries. Input is dialect B (``parse_log_b``)."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fernlog import patterns as P
from fernlog.functions import scalars as S
from fernlog.operators.logs import K, privacy_counts, split_malformed
from fernlog.storage import stored


def errors(parsed: DataFrame) -> DataFrame:
    return parsed.where(F.col("level").isin("ERROR", "CRITICAL"))


def error_groups(parsed: DataFrame) -> DataFrame:
    """Errors of a file by normalised message: count, first and last line and time (by line), first message."""
    rows = errors(parsed).select(*K, "line_no", "ts", "message", S.normalize_message(F.col("message")).alias("fingerprint"))
    timed = F.when(F.col("ts").isNotNull(), F.col("line_no"))
    out = rows.groupBy(*K, "fingerprint").agg(
        F.count("*").alias("occurrences"),
        F.min("line_no").alias("first_line"),
        F.max("line_no").alias("last_line"),
        F.min_by("ts", timed).alias("first_ts"),
        F.max_by("ts", timed).alias("last_ts"),
        F.min_by(F.substring("message", 1, 300), "line_no").alias("example"),
    )
    return out.withColumn("severity", F.when(F.col("occurrences") < 5, "medium").otherwise("high"))


def top_groups(groups: DataFrame, k: int = 1000) -> DataFrame:
    """The k commonest groups of each file."""
    rank = F.row_number().over(Window.partitionBy(*K).orderBy(F.desc("occurrences"), "fingerprint"))
    return groups.withColumn("rank", rank).where(F.col("rank") <= k)


def error_bursts_ordered(parsed: DataFrame, n: int = 5, seconds: int = 60, block: int = 3600) -> DataFrame:
    """``error_bursts`` for files whose times rise with the lines, from built-in functions alone.

    A window over (K, block of time) in time, less the later lines of the same time. Each block also gets the errors of
    the ``seconds`` before it, so that no group is larger than a block's errors however long the file is.
    """
    rows = errors(parsed).where(F.col("ts").isNotNull()).select(*K, "line_no", F.unix_micros("ts").alias("us"), "ts")
    size, width = block * 1_000_000, seconds * 1_000_000
    own = F.floor(F.col("us") / size)
    blocks = F.array_distinct(F.array(own, F.floor((F.col("us") + width) / size)))
    rows = rows.withColumn("own", own).withColumn("block", F.explode(blocks))
    near = Window.partitionBy(*K, "block").orderBy("us").rangeBetween(-width, 0)
    tied = Window.partitionBy(*K, "block", "us")
    later = F.count("*").over(tied) - F.row_number().over(tied.orderBy("line_no"))
    out = rows.withColumns({"size": F.count("*").over(near) - later, "started": F.min("ts").over(near)})
    return out.where((F.col("own") == F.col("block")) & (F.col("size") == n)).select(*K, "line_no", F.col("started").alias("started_at"), F.col("ts").alias("ended_at"), F.col("size").alias("errors"))


class BurstQueue:
    """The errors of a file that are not older than the window; they leave from the front only."""

    def __init__(self, n: int, window: int) -> None:
        self.n, self.window, self.times = n, window, deque()

    def add(self, us: int) -> int | None:
        """Takes an error, and gives the time of the queue's head if exactly n are in it."""
        self.times.append(us)
        while self.times[0] < us - self.window:
            self.times.popleft()
        return self.times[0] if len(self.times) == self.n else None


class BurstBlock:
    """A block of a file's errors in line order, walked as if the queue were empty before it.

    What the queue holds at the start only matters until an error comes that is more than the window later than all of it: this one drives
    all of it out, and with it everything that the walk from an empty queue had dropped until then, so that from there on both queues are the
    same. Before it no error of the block leaves. So a block is told by a few numbers, and a burst found in it by the latest
    time up to there (``top``), which says from what starting queues on it holds.
    """

    def __init__(self, n: int, window: int) -> None:
        self.n, self.window, self.queue = n, window, BurstQueue(n, window)
        self.first: list[int] = []
        self.top, self.count = None, 0
        self.all_tail: deque[int] = deque(maxlen=n - 1)
        self.all_rest: int | None = None

    def add(self, us: int) -> int | None:
        """Takes an error, and gives the head's time if it is a burst from an empty queue."""
        if len(self.first) < self.n - 1:
            self.first.append(us)
        if len(self.all_tail) == self.n - 1:
            out = self.all_tail[0] if self.n > 1 else us
            self.all_rest = out if self.all_rest is None else max(self.all_rest, out)
        self.all_tail.append(us)
        self.top = us if self.top is None else max(self.top, us)
        self.count += 1
        return self.queue.add(us)

    def told(self) -> dict:
        """The block: its first errors, latest time, and what is in the queue at its end, from an empty queue or if nothing of it left: the last
        n - 1 times and the latest of those before them."""
        times = list(self.queue.times)
        cut = max(0, len(times) - self.n + 1)
        return {"first": self.first, "top": self.top, "tail": times[cut:], "rest": max(times[:cut], default=None), "all_tail": list(self.all_tail), "all_rest": self.all_rest}


def _left(tail: list[int], rest: int | None, least: int) -> tuple[list[int], int | None]:
    """The queue after all in front that is earlier than ``least`` has left: it stops at the first that isn't."""
    if rest is not None and rest >= least:
        return tail, rest
    k = next((k for k, t in enumerate(tail) if t >= least), len(tail))
    return tail[k:], None


def fold_blocks(blocks: list[dict], n: int, window: int) -> tuple[list[int | None], list[tuple[int, int, int]]]:
    """For each of a file's blocks in order the latest time in the queue before it (None: empty), and the bursts among its first errors that the
    queue before it takes part in: (block, error, head's time)."""
    tail, rest, before, found = [], None, [], []
    for b, x in enumerate(blocks):
        latest = max([*tail, *([rest] if rest is not None else [])], default=None)
        before.append(latest)
        if latest is None:
            tail, rest = x["tail"], x["rest"]
            continue
        top = None
        for i, us in enumerate(x["first"]):
            top = us if top is None else max(top, us)
            if top > latest + window:
                break
            held, more = _left(tail, rest, top - window)
            if more is None and len(held) + i + 1 == n:
                found.append((b, i, held[0]))
        if x["top"] > latest + window:
            tail, rest = x["tail"], x["rest"]
        else:
            tail, rest = _left(tail, rest, x["top"] - window)
            both = [*tail, *x["all_tail"]]
            cut = max(0, len(both) - n + 1)
            rest = max([r for r in (rest, x["all_rest"], *both[:cut]) if r is not None], default=None)
            tail = both[cut:]
    return before, found


def error_bursts(parsed: DataFrame, n: int = 5, seconds: int = 60, block: int = 1_000_000) -> DataFrame:
    """A row for each error after which exactly n errors are in the file's queue of the last ``seconds``.

    The queue takes errors in line order, whatever their times are. A file is cut into blocks of ``block`` lines, which any tasks walk line
    by line from an empty queue, holding no more than the queue. A block gives its bursts and a row that tells it; these rows
    are folded file by file, which tells what was in the queue before each block, which of its bursts hold, and the few at its start.
    """
    window = seconds * 1_000_000
    rows = errors(parsed).where(F.col("ts").isNotNull()).select(*K, F.floor(F.col("line_no") / block).alias("block"), "line_no", F.unix_micros("ts").alias("us"))
    rows = rows.repartition(*K, "block").sortWithinPartitions(*K, "block", "line_no")
    names = ["line_no", "a", "b", "top", "first", "lines", "tail", "rest", "all_tail", "all_rest"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int64(), pa.list_(pa.int64()), pa.int64()]
    spec = "bundle_id string, artifact string, block bigint, " + ", ".join(f"{c} {'array<bigint>' if pa.types.is_list(k) else 'bigint'}" for c, k in zip(names, kinds, strict=True))

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batch_of = lambda found: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found, strict=True), (pa.string(), pa.string(), pa.int64(), *kinds), strict=True)], [*K, "block", *names])
        own, state, lines = None, None, []
        tell = lambda: (*own, None, None, None, (t := state.told())["top"], t["first"], lines, t["tail"], t["rest"], t["all_tail"], t["all_rest"])
        for batch in batches:
            found = []
            for row in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                if row[:3] != own:
                    if own:
                        found.append(tell())
                    own, state, lines = row[:3], BurstBlock(n, window), []
                if len(lines) < n - 1:
                    lines.append(row[3])
                head = state.add(row[4])
                if head is not None:
                    found.append((*own, row[3], head, row[4], state.top, *[None] * 6))
            if found:
                yield batch_of(found)
        if own:
            yield batch_of([tell()])

    out = stored(rows.mapInArrow(walk, spec), "bursts")

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batch_of = lambda found: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found, strict=True), (pa.string(), pa.string(), *[pa.int64()] * 5), strict=True)], [*K, "block", "line_no", "a", "b", "before"])

        def folded_file(own: tuple, blocks: list[dict]) -> Iterator[tuple]:
            before, found = fold_blocks(blocks, n, window)
            for x, t in zip(blocks, before, strict=True):
                yield (*own, x["block"], None, None, None, t)
            for b, i, head in found:
                yield (*own, blocks[b]["block"], blocks[b]["lines"][i], head, blocks[b]["first"][i], None)

        own, blocks = None, []
        for batch in batches:
            rows = []
            for x in batch.to_pylist():
                if (x["bundle_id"], x["artifact"]) != own:
                    if own:
                        rows += folded_file(own, blocks)
                    own, blocks = (x["bundle_id"], x["artifact"]), []
                blocks.append(x)
            if rows:
                yield batch_of(rows)
        if own:
            yield batch_of(list(folded_file(own, blocks)))

    # files stand one after the other in a task, so that a small one costs no call of its own
    told = out.where("line_no IS NULL").select(*K, "block", *names[3:]).repartition(*K).sortWithinPartitions(*K, "block")
    folded = stored(told.mapInArrow(fold, "bundle_id string, artifact string, block bigint, line_no bigint, a bigint, b bigint, before bigint"), "folded")
    start = folded.where("line_no IS NULL").select(*K, "block", "before")
    fine = out.where("line_no IS NOT NULL").join(start, [*K, "block"]).where(F.col("before").isNull() | (F.col("top") > F.col("before") + window))
    both = fine.select(*K, "line_no", "a", "b").unionByName(folded.where("line_no IS NOT NULL").select(*K, "line_no", "a", "b"))
    return both.select(*K, "line_no", F.timestamp_micros("a").alias("started_at"), F.timestamp_micros("b").alias("ended_at"), F.lit(n).cast("long").alias("errors"))


def correlation_chains(parsed: DataFrame, cap: int = 100) -> DataFrame:
    """The first ``cap`` events of each correlation id of a file, in line order."""
    rank = F.row_number().over(Window.partitionBy(*K, "correlation_id").orderBy("line_no"))
    rows = parsed.where(F.col("correlation_id").isNotNull()).select(*K, "correlation_id", "line_no", "ts", "service", "level")
    return rows.withColumn("position", rank).where(F.col("position") <= cap)


def log_summary(parsed: DataFrame) -> DataFrame:
    """Lines, malformed lines (they hold a NUL) and distinct correlation ids of each file."""
    ids = parsed.where("correlation_id IS NOT NULL").select(*K, "correlation_id").distinct()
    zero = F.lit(0).cast("long")
    counts = parsed.select(*K, F.lit(1).cast("long").alias("lines"), F.col("malformed").cast("long").alias("malformed_lines"), zero.alias("correlations"))
    both = counts.unionByName(ids.select(*K, zero.alias("lines"), zero.alias("malformed_lines"), F.lit(1).cast("long").alias("correlations")))
    return both.groupBy(*K).agg(*[F.sum(c).alias(c) for c in ("lines", "malformed_lines", "correlations")])


def privacy_counts_b(lines: DataFrame) -> DataFrame:
    """The second dialect's three kinds by file; malformed lines don't count."""
    return privacy_counts(split_malformed(lines).where(~F.col("malformed")), "line", K, P.B_SENSITIVE)


def intelligence_findings(parsed: DataFrame, most: int = 1000) -> DataFrame:
    """Repeated errors (the ``most`` commonest of a file) and bursts as findings; a burst is its summary and has no evidence."""
    groups = top_groups(error_groups(parsed), most)
    text = F.format_string("Observed %d occurrence(s) of a normalized error pattern.", "occurrences")
    a = groups.select(*K, F.lit("PY_REPEATED_ERROR").alias("rule_id"), F.lit("Repeated log error pattern").alias("title"), "severity", text.alias("summary"), F.lit("strong").alias("confidence"), "occurrences", F.col("first_line").alias("line_start"), F.col("last_line").alias("line_end"), F.col("example").alias("excerpt"))
    text = F.format_string("At least %d errors occurred within 60 seconds.", "errors")
    b = error_bursts(parsed).select(*K, F.lit("PY_ERROR_BURST").alias("rule_id"), F.lit("Burst of error events").alias("title"), F.lit("high").alias("severity"), text.alias("summary"), F.lit("moderate").alias("confidence"), F.col("errors").alias("occurrences"), F.lit(None).cast("long").alias("line_start"), F.lit(None).cast("long").alias("line_end"), F.lit(None).cast("string").alias("excerpt"))
    return a.unionByName(b)
