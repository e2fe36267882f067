import random

from pyspark.sql import Row

from fernlog.llm import decontam
from tests_llm_brute import leaks_of


def compare(spark, docs, items):
    d = spark.createDataFrame([Row(doc_id=a, text=b) for a, b in docs], "doc_id bigint, text string").repartition(3)
    b = spark.createDataFrame([Row(item_id=a, text=b) for a, b in items], "item_id bigint, text string")
    got = {(r.doc_id, r.item_id): (r.similarity, r.start_word) for r in decontam.leaks(d, b).collect()}
    want = leaks_of(docs, items)
    assert got.keys() == want.keys()
    for k, (score, start) in want.items():
        assert abs(got[k][0] - score) < 1e-9 and got[k][1] == start
    bad = {a for a, _ in want}
    assert sorted(r.doc_id for r in decontam.clean(d, b).collect()) == sorted(a for a, _ in docs if a not in bad)
    return want


def test_planted_passages(spark):
    rng = random.Random(8)
    vocab = [f"v{k}" for k in range(300)]
    text = lambda n: [rng.choice(vocab) for _ in range(n)]
    items = [(k, " ".join(text(rng.choice([4, 5, 6, 20, 20, 45, 700])))) for k in range(20)] + [(50, None), (51, "")]
    docs = []
    for k in range(60):
        own = text(rng.choice([0, 3, 50, 900]))
        if k % 2:
            passage = items[rng.randrange(20)][1].split()
            for _ in range(rng.choice([0, 0, 1, 2])):
                passage[rng.choice([0, -1, rng.randrange(len(passage))])] = "x"
            at = rng.randint(0, len(own))
            own[at:at] = passage
        docs.append((k, "\n ".join(own).title()))
    docs += [(100, None), (101, ""), (102, docs[1][1]), (103, docs[1][1])]
    items = [x for x in items if x[1] is None or len(x[1].split()) <= decontam.PIECE]
    assert len(compare(spark, docs, items)) > 10


def test_documents(spark, sf_dir):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    assert compare(spark, docs, items)


def test_long_items_empty_tables_and_extra_columns(spark):
    long = " ".join(f"w{k}" for k in range(1200))
    docs = spark.createDataFrame([(1, "a b " + long + " c", 5), (None, long, 6), (3, None, 7)], "doc_id bigint, text string, _key int")
    bench = spark.createDataFrame([(9, long, 1), (None, "only four words here", 1)], "item_id bigint, text string, n int")
    got = decontam.leaks(docs, bench).collect()
    assert {(r.doc_id, r.item_id, r.similarity) for r in got} == {(1, 9, 1.0), (None, 9, 1.0)}
    assert [tuple(r) for r in decontam.clean(docs, bench).collect()] == [(3, None, 7)]
    assert decontam.leaks(docs.limit(0), bench).count() == 0
    assert decontam.leaks(docs, bench.limit(0)).count() == 0
