"""Repeated publication, pages by keys, numbers from a distributed sort."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from fernlog.operators import query
from fernlog.ordering import numbered
from fernlog.sources import store


def test_a_repeated_run_leaves_one_copy(spark, tmp_path):
    path = f"file://{tmp_path}/store"
    findings = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "session_id bigint, id string")
    events = spark.createDataFrame([(1, "x"), (2, "y")], "session_id bigint, id string")
    for _ in range(2):
        store.write_store({"findings": findings, "events": events}, path)
    assert sorted(map(tuple, store.load_store(spark, path, "findings").select("session_id", "id").collect())) == [(1, "a"), (1, "b"), (2, "c")]
    # a session that is run again is replaced as a whole, the others stay
    store.write_store({"findings": spark.createDataFrame([(2, "d")], findings.schema), "events": spark.createDataFrame([(2, "z"), (3, "w")], events.schema)}, path)
    assert sorted(map(tuple, store.load_store(spark, path, "findings").select("session_id", "id").collect())) == [(1, "a"), (1, "b"), (2, "d")]
    assert sorted(map(tuple, spark.read.parquet(f"{path}/commits").select("session_id", "table", "rows").collect())) == [(1, "events", 1), (1, "findings", 2), (2, "events", 1), (2, "findings", 1), (3, "events", 1)]


def test_a_run_that_failed_is_not_read(spark, tmp_path):
    path = f"file://{tmp_path}/store"
    store.write_store({"findings": spark.createDataFrame([(1, "a")], "session_id bigint, id string")}, path)
    bad = spark.createDataFrame([(2, "c")], "session_id bigint, id string").withColumn("id", F.when(F.col("id") == "c", F.raise_error(F.lit("lost"))))
    with pytest.raises(Exception, match="lost"):
        store.write_store({"findings": spark.createDataFrame([(2, "b")], "session_id bigint, id string"), "events": bad}, path)
    assert [r.id for r in store.load_store(spark, path, "findings").collect()] == ["a"]


def test_pages_by_keys(spark):
    rng = random.Random(2)
    rows = [(datetime(2025, 1, 1) + timedelta(seconds=rng.randint(0, 40), microseconds=rng.randint(0, 2)), f"i{k:03}", k) for k in range(300)]
    make = lambda r: spark.createDataFrame(r, "ts timestamp, id string, k int")
    df, cursor, got = make(rows), None, []
    while True:
        page = query.page_after(df, ["ts", "id"], cursor, 40)
        found = [(r.ts, r.id) for r in page.collect()]
        if not found:
            break
        got += found
        cursor = query.next_cursor(page, ["ts", "id"])
        # rows that come before the cursor, or go, between two pages change nothing behind it
        rows = [r for r in rows if (r[0], r[1]) > found[-1] or rng.random() < 0.5] + [(found[0][0], f"a{len(got)}", 0)]
        df = make(rows)
    assert [x for x in got if x[1].startswith("i")] == got and len(got) == 300 and got == sorted(got)
    assert query.next_cursor(df.limit(0), ["ts", "id"]) is None
    for bad in ("x", "W10", query.encode_cursor(5)):
        with pytest.raises(ValueError, match="bad cursor"):
            query.page_after(df, ["ts", "id"], bad)


def test_a_page_reads_no_earlier_rows(spark, tmp_path):
    spark.range(10_000).withColumn("id", F.col("id").cast("string")).select(F.monotonically_increasing_id().alias("n"), "id").write.parquet(f"file://{tmp_path}/t")
    df = spark.read.parquet(f"file://{tmp_path}/t")
    cursor = query.next_cursor(df.where("n = (SELECT max(n) - 5 FROM {t})".replace("{t}", f"parquet.`file://{tmp_path}/t`")), ["n", "id"])
    page = query.page_after(df, ["n", "id"], cursor)
    plan = page._jdf.queryExecution().executedPlan().toString()
    assert page.count() == 5 and "GreaterThanOrEqual(n," in plan and "TakeOrdered" in plan and "Offset" not in plan


def test_numbers_equal_a_window(spark):
    rng = random.Random(1)
    rows = [(rng.choice("aaaaab"), rng.choice("xy"), k, rng.random()) for k in range(2_000)]
    df = spark.createDataFrame(rows, "g string, h string, k int, _part double").repartition(7)
    want, seen = {}, {}
    for g, h, k, _ in sorted(rows, key=lambda r: (r[0], r[1], -r[2])):
        seen[g, h] = seen.get((g, h), 0) + 1
        want[k] = seen[g, h]
    got = numbered(df.drop("_part"), ["g", "h"], [F.desc("k")])
    assert got.columns == ["g", "h", "k", "number"] and {r.k: r.number for r in got.collect()} == want
    assert numbered(df.drop("_part").limit(0), ["g", "h"], ["k"]).count() == 0
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan or "windowspecdefinition(g#" not in plan


def test_a_job_deletes_its_own_tables_only(spark):
    import threading

    from fernlog.storage import exists, keep_only, made, stored

    seen = {}

    def job(name):
        before = made()
        table = stored(spark.range(3), name)
        barrier.wait()
        if name == "a":
            keep_only(spark, before)
        barrier.wait()
        seen[name] = exists(spark, table._scratch)

    barrier = threading.Barrier(2, timeout=60)
    threads = [threading.Thread(target=job, args=(n,)) for n in "ab"]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert seen == {"a": False, "b": True}
