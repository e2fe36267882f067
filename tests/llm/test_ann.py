import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from fernlog.llm import ann


def brute(rows: dict[int, np.ndarray], queries: list[int], k: int) -> dict[int, list[tuple[int, float]]]:
    ids = np.array(sorted(rows))
    x = np.array([rows[i] for i in ids], float)
    out = {}
    for q in queries:
        s = x @ np.array(rows[q], float)
        order = [j for j in np.lexsort((ids, -s)) if ids[j] != q][:k]
        out[q] = [(int(ids[j]), s[j]) for j in order]
    return out


def recall(got, want) -> float:
    return float(np.mean([len({i for i, _ in want[q]} & {r.vec_id for r in got if r.query_id == q}) / max(1, len(want[q])) for q in want]))


def test_recall_and_scores_on_embeddings(spark):
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = {r.vec_id: np.array(r.embedding, float) for r in table.collect()}
    # one partition and a shallow rerank: the codes must do the work
    got = ann.search(table, F.col("vec_id") % 20 == 0, k=20, depth=60).collect()
    want = brute(rows, [i for i in rows if i % 20 == 0], 20)
    assert recall(got, want) >= 0.9
    for r in got:
        assert abs(r.score - rows[r.query_id] @ rows[r.vec_id]) < 1e-12
    by: dict = {}
    for r in sorted(got, key=lambda r: (r.query_id, r.rank)):
        by.setdefault(r.query_id, []).append((-r.score, r.vec_id))
    assert all(x == sorted(x) and len(x) == 20 for x in by.values())


def test_score_aware_loss_is_better_for_large_products():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(4000, 32))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    aware, plain = ann.Quantiser.fit(x, 0.4), ann.Quantiser.fit(x, 0.0)
    assert aware.eta > 1 and plain.eta == 1

    def parallel(q):
        codes = q.encode(x)
        r = x - np.concatenate([b[codes[:, m]] for m, b in enumerate(q.books)], axis=1)[:, :32]
        return float(((r * x).sum(axis=1) ** 2).mean())

    assert parallel(aware) < 0.8 * parallel(plain)


def test_tables_give_the_product_with_the_decoded_vector():
    rng = np.random.default_rng(2)
    x, q = rng.normal(size=(300, 7)), rng.normal(size=(5, 7))
    own = ann.Quantiser.fit(x)
    codes = own.encode(x)
    decoded = np.concatenate([b[codes[:, m]] for m, b in enumerate(own.books)], axis=1)[:, :7]
    t, packed = ann.tables(own, q), ann._packed_codes(codes)
    assert np.allclose(sum(t[b][packed[:, b]] for b in range(len(t))), decoded @ q.T, atol=1e-5)


@pytest.mark.parametrize("batch", [10_000, 150])
def test_batches_change_nothing(spark, batch):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(1_200, 8))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<double>").repartition(2)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        got = ann.search(df, F.col("vec_id") % 20 == 0, k=10, depth=60).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert recall(got, brute(dict(enumerate(x)), list(range(0, 1_200, 20)), 10)) >= 0.9
    sizes = [b.num_rows for b in ann._blocks(iter([pa.record_batch([pa.array(range(n))], ["x"]) for n in (5, 1, 9, 0, 4)]), 4)]
    assert sizes == [4, 4, 4, 4, 3]


@pytest.mark.parametrize("slice_", [4_096, 3])
def test_ties_copies_and_bad_vectors(spark, monkeypatch, slice_):
    monkeypatch.setattr(ann, "SLICE", slice_)
    rng = np.random.default_rng(3)
    rows = {i: rng.normal(size=6).round(2).tolist() for i in range(0, 60)}
    for i in range(60, 200):
        rows[i] = rows[0]  # one vector holds most rows
    bad = [(1000, None), (1020, [0.0] * 6), (1040, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (1060, [float("nan")] * 6), (1080, [float("inf")] + [1.0] * 5), (None, [1.0] * 6)]
    short, again = (1100, [1.0, 2.0]), (3, [9.0] * 6)  # counts as ending in zeros; a second row of one id
    data = [(i, v, 1) for i, v in rows.items()] + [(i, v, 1) for i, v in [*bad, short, again]]
    df = spark.createDataFrame(data, "vec_id bigint, embedding array<float>, score int").repartition(3)
    got = ann.search(df, F.col("vec_id") % 20 == 0, k=20).collect()
    exact = [(i, np.array(v, np.float32).astype(float)) for i, v in [*rows.items(), (1100, [*short[1], 0, 0, 0, 0]), again]]
    want = set()
    for place, (q, x) in enumerate(exact):
        if q % 20 == 0:
            others = sorted((-float(x @ y), i) for at, (i, y) in enumerate(exact) if at != place)
            want |= {(q, n + 1, i) for n, (_, i) in enumerate(others[:20])}
    assert {(r.query_id, r.rank, r.vec_id) for r in got} == want and len(got) == len(want)
    few = ann.search(df.where("vec_id in (0, 5, 20)"), F.col("vec_id") % 20 == 0).collect()
    assert len(few) == 4
    assert ann.search(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0
    assert ann.search(df.where("vec_id = 5"), F.col("vec_id") % 20 == 0).count() == 0
