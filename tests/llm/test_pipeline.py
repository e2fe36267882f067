import pytest

import corpus_pipeline
from fernlog.llm import mixing, toxicity
from fernlog.llm.common import made
from tests_llm_brute import leaks_of, tokens


def rows(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


def firsts_of(docs):
    """The smallest id of each group linked by a Jaccard similarity of 0.8 or more of five-word sets, by all pairs."""
    sets, root = [], {}
    for i, text in docs:
        w = tokens(text)
        sets.append((i, {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()))
        root[i] = i

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if (not a and not b) or len(a & b) >= 0.8 * len(a | b):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return sorted({(find(i),) for i in root}, key=repr)


def test_stages_against_plain_versions(spark, sf_dir):
    """Each stage's decisions against what its operator, or a brute-force version, says about the same input."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    bench = {r.item_id: r.text for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()}
    columns = docs.columns
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "near duplicates", "decontamination", "mixing", "sharding"]
    stage = dict(corpus_pipeline.STAGES)

    net = toxicity.fit(docs, labels)
    a = stage["toxicity"](spark, docs, sf_dir).cache()
    all_rows = docs.collect()
    scores = net.score([r.text for r in all_rows])
    assert a.columns == columns
    assert rows(a, "doc_id") == sorted([(r.doc_id,) for r, s in zip(all_rows, scores, strict=True) if s < 0.5], key=repr)

    b = stage["near duplicates"](spark, a, sf_dir).cache()
    kept = rows(b, "doc_id")
    assert b.columns == columns and kept == firsts_of([(r.doc_id, r.text) for r in a.collect()])

    c = stage["decontamination"](spark, b, sf_dir).cache()
    bad = {d for d, _ in leaks_of([(r.doc_id, r.text) for r in b.collect()], list(bench.items()))}
    assert c.columns == columns and rows(c, "doc_id") == [x for x in kept if x[0] not in bad]

    d = stage["mixing"](spark, c, sf_dir).cache()
    copies = {r.doc_id: r.copies for r in mixing.mix(c, by_text=True).collect()}
    assert d.columns == columns and rows(d, "doc_id") == sorted([(i,) for i, n in copies.items() for _ in range(n)], key=repr)

    e = stage["sharding"](spark, d, sf_dir).collect()
    assert sorted([(r.doc_id,) for r in e], key=repr) == rows(d, "doc_id")
    counts = [sum(r.shard == s for r in e) for s in range(40)]
    assert max(counts) - min(counts) <= 1
    for s in range(40):
        assert sorted(r.slot for r in e if r.shard == s) == list(range(counts[s]))


def test_run_repeats(spark, sf_dir):
    a = corpus_pipeline.run(spark, sf_dir).select("doc_id", "shard", "slot").collect()
    b = corpus_pipeline.run(spark, sf_dir).select("doc_id", "shard", "slot").collect()
    assert sorted(map(tuple, a)) == sorted(map(tuple, b)) and a


@pytest.mark.parametrize("empty", [False, True])
def test_defined_cases(spark, tmp_path, empty):
    """Nulls in any column, empty and long texts, repeated rows, clashing names, empty tables: each stage gives its defined result."""
    passage = " ".join(f"item{k}" for k in range(20))
    data = [(1, None, "a"), (2, "", "a"), (None, "words without an id are kept", None), (4, "long " * 60_000 + "end", "b"), (5, f"some words before {passage} and after", "b"), (6, "a text of seven words that repeats", None), (6, "a text of seven words that repeats", None), (7, "A text of seven words that repeats", "c")]
    more = {"shard": "int", "slot": "string", "size": "int", "score": "double", "row": "int", "key": "string", "_row": "int", "component_id": "int", "copies": "int", "rate": "int", "keep": "boolean", "fp": "int"}
    spec = "doc_id bigint, text string, source string, " + ", ".join(f"{k} {v}" for k, v in more.items())
    docs = spark.createDataFrame([(*r, *[None] * len(more)) for r in data], spec).repartition(3)
    tables = {"documents": docs, "labels": spark.createDataFrame([(1, 1), (None, 1), (6, None)], "doc_id bigint, toxic int"), "benchmark": spark.createDataFrame([(1, passage), (2, None), (None, "x")], "item_id bigint, text string")}
    for name, df in tables.items():
        (df.limit(0) if empty else df).write.parquet(f"{tmp_path}/{name}.parquet")
    before, sf_dir = made(), f"file://{tmp_path}"
    got = corpus_pipeline.run(spark, sf_dir)
    assert sorted(got.columns) == sorted(docs.columns) and made() - before < 4
    found = got.collect()
    if empty:
        assert not found
        return
    left = {(r.doc_id, r.text and r.text[:9]) for r in found}
    assert left <= {(1, None), (None, "words wit"), (4, "long long"), (6, "a text of")} and (4, "long long") in left
    assert all(r.shard is not None and r.slot is not None and r.size is None for r in found)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf_dir)
        assert docs.columns == tables["documents"].columns, name
        ids = [r.doc_id for r in docs.collect()]
        if name == "toxicity":
            assert len(ids) == len(data)
        if name == "near duplicates":
            assert sorted(map(str, ids)) == ["1", "4", "5", "6", "None"]
        if name == "decontamination":
            assert sorted(map(str, ids)) == ["1", "4", "6", "None"]
