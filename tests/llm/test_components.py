import numpy as np
import pyarrow as pa
import pytest
from fernlog.llm import common


def roots_of(edges):
    """Smallest reachable node of every other node, by search."""
    near = {}
    for u, v in edges:
        near.setdefault(u, set()).add(v)
        near.setdefault(v, set()).add(u)
    found = {}
    for low in sorted(near):
        if low in found:
            continue
        open_, found[low] = [low], low
        while open_:
            for v in near[open_.pop()]:
                if v not in found:
                    found[v] = low
                    open_.append(v)
    return {k: v for k, v in found.items() if k != v}


def some_edges():
    rng = np.random.default_rng(5)
    chance = rng.integers(-(1 << 62), 1 << 62, 900)
    edges = [tuple(map(int, chance[rng.integers(0, 900, 2)])) for _ in range(500)]
    path = [int(x) for x in rng.permutation(np.arange(10_000, 10_300))]
    return edges + list(zip(path, path[1:], strict=False)) + [(7, k) for k in range(20_000, 20_100)] + [(5, 5)]


@pytest.fixture
def many_partitions(spark):
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def tasks_of(spark, group, work):
    spark.sparkContext.setJobGroup(group, group)
    found, tracker = work(), spark.sparkContext.statusTracker()
    stages = {s for j in tracker.getJobIdsForGroup(group) for s in tracker.getJobInfo(j).stageIds}
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return found, sum(i.numCompletedTasks for s in stages if (i := tracker.getStageInfo(s)))


def test_few_links_take_few_tasks_whatever_the_shuffle_partitions(spark, many_partitions):
    """Each round dealt its rows to all partitions several times, and what 18,000 tasks told the driver of 211 partitions filled its memory."""
    edges = some_edges()
    df = spark.createDataFrame([*edges, (None, 3), (3, None)], "a bigint, b bigint").coalesce(4)
    found, tasks = tasks_of(spark, "few", lambda: common.connected_components(df, "a", "b").collect())
    assert {r["node"]: r["root"] for r in found} == roots_of(edges)
    assert len(found) == len(roots_of(edges))
    assert tasks <= 30, tasks


def test_more_links_than_a_task_joins_go_through_the_rounds(spark, monkeypatch):
    edges = some_edges()
    monkeypatch.setattr(common, "TASK_EDGES", 200)
    df = spark.createDataFrame(edges, "a bigint, b bigint").repartition(6)
    found = common.connected_components(df, "a", "b").collect()
    assert {r["node"]: r["root"] for r in found} == roots_of(edges)
    assert len(found) == len(roots_of(edges))


def test_a_task_joins_so_many_edges_at_a_time(monkeypatch):
    edges = [(u, v) for u, v in some_edges() if u != v]
    monkeypatch.setattr(common, "TASK_EDGES", 64)
    batches = [pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*edges[k : k + 150], strict=True)], ["u", "v"]) for k in range(0, len(edges), 150)]
    out = list(common._joined(batches))
    assert len(out) == -(-len(edges) // 64)
    left = [(u, v) for b in out for u, v in zip(b["u"].to_pylist(), b["v"].to_pylist(), strict=True)]
    assert roots_of(left) == roots_of(edges)


def test_no_links(spark):
    df = spark.createDataFrame([(1, 1)], "a bigint, b bigint")
    assert common.connected_components(df, "a", "b").collect() == []
    assert common.connected_components(df.where("a > 1"), "a", "b").collect() == []
