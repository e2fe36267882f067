"""Bursts in blocks and in streams against the plain queue."""

import json
import os
import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from fernlog.operators import intelligence, logs
from fernlog.streaming import jobs

SECOND = 1_000_000


def plain(times, n, window):
    queue, out = [], []
    for i, t in enumerate(times):
        queue.append(t)
        while queue[0] < t - window:
            queue.pop(0)
        if len(queue) == n:
            out.append((i, queue[0], t))
    return out


def in_blocks(times, n, window, cuts):
    blocks, found = [], []
    for b, (lo, hi) in enumerate(zip([0, *cuts], [*cuts, len(times)], strict=True)):
        if lo == hi:
            continue
        state = intelligence.BurstBlock(n, window)
        for i in range(lo, hi):
            head = state.add(times[i])
            if head is not None:
                found.append((len(blocks), i, head, times[i], state.top))
        blocks.append(state.told() | {"lo": lo})
    before, border = intelligence.fold_blocks(blocks, n, window)
    out = [(i, head, t) for b, i, head, t, top in found if before[b] is None or top > before[b] + window]
    return sorted(out + [(blocks[b]["lo"] + i, head, blocks[b]["first"][i]) for b, i, head in border])


@pytest.mark.parametrize("n", [1, 2, 3, 5])
def test_blocks_give_the_bursts_of_the_whole(n):
    rng = random.Random(n)
    seen = 0
    for _ in range(4000):
        size = rng.randint(0, 40)
        walk, times = 0, []
        for _ in range(size):
            walk += rng.choice([0, 1, 1, 5, 20, -3, -30, 61])
            times.append(walk if rng.random() < 0.7 else rng.randint(-100, 200))
        cuts = sorted(rng.choices(range(size + 1), k=rng.randint(0, 6)))
        want = plain(times, n, 20)
        seen += len(want)
        assert in_blocks(times, n, 20, cuts) == want, (times, cuts)
    assert seen > 4000


def test_files_in_small_blocks(spark):
    rng = random.Random(9)
    rows, want = [], set()
    for f in "pq":
        times = []
        for k in range(400):
            t = 9 * k + rng.choice([0, 0, 1, -40, 150])
            level = rng.choice(["ERROR", "CRITICAL", "INFO"])
            rows.append(("b", f, k + 1, datetime(2025, 1, 1, tzinfo=timezone.utc) + timedelta(seconds=t) if rng.random() < 0.95 else None, level))
            if level != "INFO" and rows[-1][3]:
                times.append((k + 1, t))
        want |= {(f, times[i][0], a, b) for i, a, b in plain([t for _, t in times], 5, 60)}
    df = spark.createDataFrame(rows, "bundle_id string, artifact string, line_no bigint, ts timestamp, level string").repartition(5)
    start = datetime(2025, 1, 1)
    seconds = lambda t: int((t - start).total_seconds())
    for block in (1_000_000, 50, 7, 1):
        got = intelligence.error_bursts(df, block=block).collect()
        assert {(r.artifact, r.line_no, seconds(r.started_at), seconds(r.ended_at)) for r in got} == want and len(got) == len(want) > 5
    assert intelligence.error_bursts(df.limit(0)).count() == 0


def run_stream(spark, tmp_path, schema, batches, job, mode):
    """Rows that a job gives for files that arrive one by one."""
    src = tmp_path / "in"
    src.mkdir()
    for k, rows in enumerate(batches):
        path = src / f"{k:03}.json"
        path.write_text("\n".join(json.dumps(r) for r in rows))
        os.utime(path, (1_700_000_000 + k, 1_700_000_000 + k))  # the stream takes files by age
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(f"file://{src}")
    states = []
    q = job(stream).writeStream.format("memory").queryName("out_" + tmp_path.name.replace("-", "_")).outputMode(mode).option("checkpointLocation", f"file://{tmp_path}/cp").start()
    try:
        q.processAllAvailable()
        states = [p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]]
    finally:
        q.stop()
    return spark.table("out_" + tmp_path.name.replace("-", "_")).collect(), states


def test_live_bursts_equal_those_of_the_batch(spark, tmp_path):
    rng = random.Random(3)
    lines, t = [], datetime(2025, 1, 1, 10)
    for k in range(1, 301):
        t += timedelta(seconds=rng.choice([0, 1, 4, 9, 30, 70]))
        for f in "xy":
            lines.append({"bundle_id": "b", "artifact": f, "line_no": k, "line": f"{t.isoformat()}Z {rng.choice(['ERROR', 'INFO', 'CRITICAL'])} service=a failed"})
    batches = []
    for lo in range(0, len(lines), 60):
        some = lines[lo : lo + 60]
        rng.shuffle(some)
        batches.append(some)
    # late enough to let all others out
    batches.append([{"bundle_id": "b", "artifact": "z", "line_no": 1, "line": "2025-01-03T00:00:00Z ERROR end"}])
    batches.append([{"bundle_id": "b", "artifact": "z", "line_no": 2, "line": "2025-01-05T00:00:00Z ERROR end"}])
    schema = "bundle_id string, artifact string, line_no bigint, line string"
    got, states = run_stream(spark, tmp_path, schema, batches, lambda s: jobs.stream_exact_bursts(logs.parse_log_b(s), late="30 minutes"), "append")
    want = intelligence.error_bursts(logs.parse_log_b(spark.createDataFrame([r for b in batches for r in b], schema))).collect()
    assert sorted(got) == sorted(want) and len(want) > 5
    assert max(states) >= 2 and states[-1] <= 1


def test_sessions_leave_the_state_when_they_have_ended(spark, tmp_path):
    at = lambda m: (datetime(2025, 1, 1) + timedelta(minutes=m)).isoformat()
    batches = [
        [{"session_id": 1, "sequence": 1, "stage": "running", "ts": at(0)}, {"session_id": 2, "sequence": 1, "stage": "queued", "ts": at(1)}],
        [{"session_id": 1, "sequence": 3, "stage": "completed", "ts": at(2)}, {"session_id": 1, "sequence": 2, "stage": "running", "ts": at(3)}],
        [{"session_id": 3, "sequence": 1, "stage": "running", "ts": at(300)}],
        [{"session_id": 3, "sequence": 2, "stage": "running", "ts": at(301)}],
        [{"session_id": 3, "sequence": 3, "stage": "failed", "ts": at(302)}],
    ]
    got, states = run_stream(spark, tmp_path, "session_id bigint, sequence bigint, stage string, ts timestamp", batches, jobs.stream_live_sessions, "update")
    assert [(r.session_id, r.sequence, r.stage, r.events, r.ended) for r in got if r.session_id == 1] == [(1, 1, "running", 1, False), (1, 3, "completed", 3, True)]
    assert [r.stage for r in got if r.session_id == 3] == ["running", "running", "failed"]
    assert max(states) == 3 and states[-1] == 2


def test_small_files_are_folded_without_a_call_each(spark, monkeypatch):
    """A file costs no Python group of its own: at 0.36 M files such calls were most of the query's time."""
    from pyspark.sql.pandas.group_ops import PandasGroupedOpsMixin

    def refused(*_, **__):
        raise AssertionError("a call for each file")

    monkeypatch.setattr(PandasGroupedOpsMixin, "applyInPandas", refused)
    rows = [(f"b{f % 7}", f"a{f}.log", i, "ERROR", datetime(2024, 1, 1) + timedelta(seconds=(i * 37 % 11) * (f % 5 + 1))) for f in range(60) for i in range(1, 30)]
    parsed = spark.createDataFrame(rows, "bundle_id string, artifact string, line_no long, level string, ts timestamp")
    want = set()
    for f in range(60):
        queue = intelligence.BurstQueue(5, 60_000_000)
        want |= {(f"a{f}.log", i) for _, a, i, _, t in rows if a == f"a{f}.log" and queue.add(int(t.replace(tzinfo=timezone.utc).timestamp()) * 1_000_000) is not None}
    for block in (4, 1000):
        assert {(r.artifact, r.line_no) for r in intelligence.error_bursts(parsed, block=block).collect()} == want
