import math
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from fernlog.llm import lm


def words(text):
    out, now = [], ""
    for c in text or "":
        if c in " \t\n\x0b\x0c\r":
            out, now = out + [now] if now else out, ""
        else:
            now += chr(ord(c) + 32) if "A" <= c <= "Z" else c
    return out + [now] if now else out


def check_base(got, rows):
    held = {i: i is None or zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in rows}
    c = Counter()
    for i, t in rows:
        if not held[i]:
            c.update([*words(t), "\n"])
    n, each = c.total(), c.total() + 0.1 * (len(c) + 1)
    want = {}
    for i, t in rows:
        w = [*words(t), "\n"]
        want[i] = (held[i], len(w), sum(c[x] > 0 for x in w), n, sum(math.log10((c[x] + 0.1) / each) for x in w))
    assert len(got) == len(rows)
    for r in got:
        a = want[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == a[:4]
        assert math.isclose(r.base_score, a[4], rel_tol=1e-9)


def test_base_and_gain_on_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = lm.score_documents(docs).collect()
    check_base(got, [(r.doc_id, r.text) for r in docs.collect()])
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_rare_words_by_join(spark):
    """With room for a few words at hand, the rest comes from the table of counts, with the same scores."""
    rows = [(i, f"the cat{i % 7} sat on mat{i} é\x85x THE\n\x0bend") for i in range(60)] + [(100, None), (101, ""), (102, "new words only"), (None, "the")]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id bigint, text string, row int")
    base = docs.select("doc_id", F.coalesce(lm.fold(F.col("doc_id"), 10) == 0, F.lit(True)).alias("held_out"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    big = lm.score(base, lm.fit(base.where("not held_out"))).collect()
    model = lm.fit(base.where("not held_out"), head=3)
    assert len(model.vocabulary.words) <= 3
    small = lm.score(base, model).collect()
    check_base(big, rows)
    check_base(small, rows)
    scores = {r.doc_id: r.score for r in big}
    assert all(math.isclose(r.score, scores[r.doc_id], rel_tol=1e-6) for r in small)


def test_defined_cases(spark):
    docs = spark.createDataFrame([(None, None), (None, "a b")], "doc_id bigint, text string")
    got = lm.score_documents(docs).collect()
    assert [r.n_known for r in got] == [0, 0] and all(math.isfinite(r.score) and math.isfinite(r.base_score) for r in got)
    assert lm.score_documents(docs.limit(0)).count() == 0


def test_model_is_a_distribution():
    rng = np.random.default_rng(1)
    net = lm.LogBilinear.start(rng.integers(0, 100, lm.UNITS))
    units = rng.integers(0, lm.UNITS, 3000)
    context = rng.integers(0, lm.UNITS, (3000, lm.CONTEXT))
    net.learn(context, units, rng, 0.1)
    total = sum(10 ** net.log_probabilities(context[:5], np.full(5, u)) for u in range(lm.UNITS))
    assert np.allclose(total, 1, atol=1e-5)


def test_noise_contrastive_learning_finds_the_pattern():
    rng = np.random.default_rng(4)
    units = np.tile(np.arange(8), 4000)
    context = np.stack([np.roll(units, k + 1) for k in range(lm.CONTEXT)], axis=1)
    net = lm.LogBilinear.start(np.bincount(units, minlength=lm.UNITS))
    for _ in range(5):
        net.learn(context, units, rng, 0.1)
    assert net.log_probabilities(context[100:108], units[100:108]).mean() > math.log10(0.6)
