import math
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from fernlog.llm import langid


def slow_bits(train: list[str], text: str) -> float:
    """Code length by walking the contexts one by one, from the longest to the empty one."""
    counts, order_ = defaultdict(Counter), langid.ORDER
    for t in train:
        b = b" " * order_ + t.encode().lower()
        for i in range(order_, len(b)):
            for order in range(order_ + 1):
                counts[b[i - order : i]][b[i]] += 1
    # shorter contexts hold the sums over all longer ones
    total, b = 0.0, b" " * order_ + text.encode().lower()
    for i in range(order_, len(b)):
        p, weight = 0.0, 1.0
        for order in range(order_, -1, -1):
            c = counts[b[i - order : i]]
            n, q = sum(c.values()), len(c)
            if n:
                p += weight * c[b[i]] / (n + q)
                weight *= q / (n + q)
        p += weight / 256
        total -= math.log2(p)
    return total


def model_of(texts: dict[str, list[str]]):
    rows = [(lang, t) for lang, ts in texts.items() for t in ts]
    batch = pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows]), pa.array([r[1] for r in rows])], ["lang", "text"])
    sums = {lang: Counter() for lang in sorted(texts)}
    for b in langid._count([batch]):
        for lang, gram, n in zip(*(c.to_pylist() for c in b.columns), strict=True):
            sums[lang][gram] += n
    levels = []
    for size in range(1, langid.ORDER + 2):
        level = []
        for own in sums.values():
            nodes = Counter()
            for gram, n in own.items():
                nodes[gram & (1 << 8 * size) - 1] += n
            keys = sorted(nodes)
            level.append((np.array(keys, np.int64), np.array([nodes[k] for k in keys], np.int64)))
        levels.append(level)
    return langid.grow(levels, {k: len(v) for k, v in texts.items()})


@pytest.mark.parametrize("held", [1 << 20, 64])
def test_code_lengths_against_plain_contexts(monkeypatch, held):
    monkeypatch.setattr(langid, "_HELD", held)
    rng = random.Random(2)
    texts = {"aa": ["".join(rng.choice("abc é") for _ in range(60)) for _ in range(5)], "bb": ["".join(rng.choice("cdx ñ") for _ in range(60)) for _ in range(4)]}
    model = model_of(texts)
    tried = ["abc éab", "xdc ñ", "zzz", "A", "", "Éé\n" * 40, texts["aa"][0]]
    want = [[slow_bits(texts[k], t) for k in model.langs] for t in tried]
    assert np.allclose(model.lengths(tried), want, rtol=1e-4)


def test_continuations_of_a_context_are_a_distribution():
    model = model_of({"x": ["the quick brown fox", "jumps"], "y": ["über"]})
    for context in (b"    ", b"quic", b"zzzz", b" the", b"\xc3\xbcbe"):
        head = int.from_bytes(context, "big") << 8
        p = np.exp2(-model._bits(head + np.arange(256)).astype(np.float64))
        assert np.allclose(p.sum(axis=0), 1, atol=1e-5)


def test_rare_nodes_are_left_out_by_share(spark, monkeypatch):
    """With a large share trees are small, closed under shorter contexts, and still tell the languages apart."""
    docs = spark.createDataFrame([(i, t, lang) for i, (t, lang) in enumerate([("the cat sat on the mat " * 9, "en"), ("el gato en la casa " * 9, "es")] * 20)], "doc_id bigint, text string, lang string")
    whole = langid.fit(docs)
    monkeypatch.setattr(langid, "SHARE", 0.05)
    model = langid.fit(docs)
    assert all(len(n) < len(w) for n, w in zip(model.nodes[3:], whole.nodes[3:], strict=True)) and all(len(n) <= 2 * 20 for n in model.nodes)
    for size in range(2, langid.ORDER + 2):
        assert set(model.nodes[size - 1] & (1 << 8 * (size - 1)) - 1) <= set(model.nodes[size - 2])
    assert langid.predict(model, ["the mat", "la casa"])[0] == ["en", "es"]


def test_steps_do_not_change_lengths(monkeypatch):
    model = model_of({"x": ["abc abd abe"], "y": ["xyz"]})
    texts = ["abcd xyz " * 50, "", "x"]
    whole = model.lengths(texts)
    monkeypatch.setattr(langid, "_STEP", 7)
    assert np.allclose(model.lengths(texts), whole)


def test_held_out_accuracy(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = {r.doc_id: r for r in langid.languages(docs).collect()}
    truth = {r.doc_id: r.lang for r in docs.collect()}
    held = [i for i, r in got.items() if r.held_out]
    assert len(got) == len(truth)
    assert np.mean([got[i].lang_pred == truth[i] for i in held]) > 0.95


def test_defined_cases(spark):
    rows = [(1, "hola que tal", "es"), (2, "the cat is here", "en"), (2, "the cat is here", "en"), (None, "the", "en"), (4, None, "en"), (5, "", None), (6, "12 !", "es"), (7, "the cat" * 5000, None)]
    docs = spark.createDataFrame([(*r, "z") for r in rows], "doc_id bigint, text string, lang string, score string")
    got = langid.languages(docs).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert by[None].held_out
    assert [by[i].lang_pred for i in (4, 5, 6)] == ["und"] * 3
    assert [by[i].score for i in (4, 5, 6)] == [0.0] * 3
    assert by[7].lang_pred == "en"
    assert langid.languages(docs.limit(0)).count() == 0
    assert {r.lang_pred for r in langid.languages(docs.where("lang is null")).collect()} == {"und"}
