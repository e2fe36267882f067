import math

import numpy as np
from pyspark.sql import functions as F

from fernlog.llm import lm


def texts_of(spark, rows):
    return spark.createDataFrame([(k, bytearray(t, "ascii")) for k, t in enumerate(rows)], "doc_id bigint, text binary")


def test_every_token_is_a_target(spark):
    """Texts of three words and an end: a pass over each fourth token would see first words only."""
    texts = texts_of(spark, ["aaa bbb ccc", "ddd eee fff"] * 10_000).repartition(1)
    model = lm.fit(texts, pilot=0)
    flat, _, units, sizes = model.vocabulary.stream([b"aaa bbb ccc", b"ddd eee fff"])
    got = model.network.log_probabilities(lm.contexts(units, sizes), units)
    share = np.log10(model.vocabulary.sizes[units] / model.tokens)
    for k in (1, 2, 5, 6):
        assert got[k] > share[k] + 0.1, flat[k]


def test_units_follow_the_vocabulary(spark):
    letters = "abcdefghijklmnopqrstuvwxyz0123456789"
    words = [a + b + c + d for d in "xy" for a in letters for b in letters for c in letters]
    model = lm.fit(texts_of(spark, [" ".join(words[k::50]) for k in range(50)]))
    kinds = len(words) + 1
    assert len(model.vocabulary.sizes) == len(model.network.b) == math.isqrt(kinds) > lm.UNITS
    assert model.vocabulary.sizes.sum() == model.tokens


def test_scores_against_a_plain_version(spark):
    """The score of every text from the model's weights, word by word."""
    rows = [f"the cat{k % 5} sat on mat{k % 3} and cat{k % 7} ran" for k in range(300)] + ["", "unseen words cat1 here", "the " * 5_000]
    docs = texts_of(spark, rows).withColumn("held_out", F.col("doc_id") % 10 == 0)
    model = lm.fit(docs)
    c = {bytes(r["word"]): r["c"] for r in model.counts.collect()}
    voc, net = model.vocabulary, model.network
    for r in lm.score(docs, model).collect():
        before, total = [0] * lm.CONTEXT, 0.0
        for w in lm.tokens(rows[r.doc_id].encode()):
            u = voc.unit(w)
            s = sum(net.r[before[i]].astype(float) @ net.m[i] for i in range(lm.CONTEXT)) @ net.t.T.astype(float) + net.b
            inside = math.log10(c.get(w, 0) + lm.ADD) - math.log10(voc.sizes[u] + lm.ADD * (voc.kinds[u] + 1))
            total += (s[u] - s.max() - math.log(np.exp(s - s.max()).sum())) / math.log(10) + inside
            before = [u, *before[:-1]]
        assert math.isclose(r.score, total, rel_tol=1e-4, abs_tol=1e-4)
    assert {tuple(r) for r in lm.score(docs, model).collect()} == {tuple(r) for r in lm._scores(model.walked, model).collect()}


def test_sums_without_a_table():
    """Where the table of contexts would be too large the sums are worked out for the contexts at hand."""
    rng = np.random.default_rng(3)
    net = lm.LogBilinear.start(rng.integers(1, 99, 300))
    context, units = rng.integers(0, 300, (500, lm.CONTEXT)), rng.integers(0, 300, 500)
    want = net.log_probabilities(context, units)
    net.sums, lm._SUMS = None, 1
    try:
        assert np.allclose(net.log_probabilities(context, units), want, atol=1e-6)
    finally:
        lm._SUMS = 1 << 24
