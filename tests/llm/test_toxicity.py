import random

import numpy as np
import pytest

from fernlog.llm import toxicity


def corpus(n: int, seed: int):
    rng = random.Random(seed)
    plain = ["".join(rng.choice("abdeglmnorst") for _ in range(rng.randint(3, 7))) for _ in range(300)]
    stems = ["zukk", "vopp", "quax"]
    texts, labels = [], []
    for k in range(n):
        words = [rng.choice(plain) for _ in range(rng.choice([5, 40, 200]))]
        if bad := k % 4 == 0:
            for _ in range(rng.randint(1, 3)):
                words.insert(rng.randrange(len(words)), rng.choice(stems) + rng.choice(["", "le", "or", "ast"]))
        texts.append(" ".join(words))
        labels.append(int(bad))
    return texts, labels


@pytest.fixture(scope="module")
def net():
    return toxicity.train(*corpus(800, 1))


def test_learns_words_and_stems(net):
    texts, labels = corpus(300, 1)
    got = net.score(texts[-200:]) >= 0.5
    assert (got == np.array(labels[-200:])).mean() > 0.97
    unseen = ["tarn mole bane zukkenbar gelt", "tarn mole bane gelt"]
    a, b = net.score(unseen)
    assert a > b


def plain_score(net, text):
    """Every window word by word: inputs, both directions step by step, attention, the highest probability."""
    sigmoid = lambda x: 1 / (1 + np.exp(-x))
    p, words, h = {k: v.astype(float) for k, v in net.p.items()}, toxicity.tokens(text), toxicity._H
    best = 0.0
    for start in range(0, max(1, len(words) - toxicity.WINDOW + toxicity.STRIDE), toxicity.STRIDE):
        window, inputs = words[start : start + toxicity.WINDOW], []
        for w in window:
            rows = [p["char"][net.gram_ids[g]] for g in toxicity.grams(w) if g in net.gram_ids]
            mean = np.mean(rows, axis=0) if rows else np.zeros(p["char"].shape[1])
            inputs.append(np.concatenate([p["word"][net.word_ids.get(w, 0)], mean, [max([0.0, *[r[0] for r in rows]])]]))
        states = []
        for d, order in ((0, range(len(window))), (1, reversed(range(len(window))))):
            state, own = np.zeros(h), [None] * len(window)
            for i in order:
                x = inputs[i] @ p["w"][d] + p["b"][d][0]
                z, r = np.split(sigmoid(x[: 2 * h] + state @ p["u"][d]), 2)
                state = (1 - z) * state + z * np.tanh(x[2 * h :] + (r * state) @ p["un"][d])
                own[i] = state
            states.append(own)
        seq = [np.concatenate([a, b]) for a, b in zip(*states, strict=True)]
        weights = np.exp([s @ p["att"] for s in seq])
        pooled = sum(w * s for w, s in zip(weights / weights.sum(), seq, strict=True))
        best = max(best, sigmoid(pooled @ p["out"] + p["bias"][0]))
    return best


def test_scores_against_plain_steps(net):
    texts, _ = corpus(12, 21)
    texts += ["one", "zukk mole", "word " * 48, "word " * 49 + "vopple"]
    assert np.allclose(net.score(texts), [plain_score(net, t) for t in texts], atol=1e-4)


def test_held_out_labels(spark):
    sf_dir = "/root/testdata/sf0.1"  # at sf0.01 some 300 labels give 0.90
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    scored = docs.select("doc_id", toxicity.toxicity(docs, labels).alias("score"))
    held = {r.doc_id: r.toxic for r in labels.where(toxicity.fold(labels["doc_id"], 5) == 0).collect()}
    got = [(r.score, held[r.doc_id]) for r in scored.collect() if held.get(r.doc_id) is not None]
    bad, good = [s for s, t in got if t == 1], [s for s, t in got if t == 0]
    assert len(bad) > 3 and len(good) > 20
    assert np.mean([(s >= 0.5) == (t == 1) for s, t in got]) > 0.95
    assert np.mean([b > g for b in bad for g in good]) > 0.95


def test_windows_cover_whole_texts(net):
    lengths = np.array([0, 1, 48, 49, 84, 85, 5000])
    doc, starts, sizes = toxicity.windows(lengths)
    base = np.cumsum(lengths) - lengths
    for d, n in enumerate(lengths):
        seen = np.zeros(n, bool)
        for s, k in zip(starts[doc == d] - base[d], sizes[doc == d], strict=True):
            assert 0 < k <= 48
            seen[s : s + k] = True
        assert seen.all()
    texts, _ = corpus(40, 9)
    long = " ".join(texts * 20) + " zukk vopp zukk"
    assert net.score([long])[0] > 0.5


def test_edge_texts(net):
    got = net.score([None, "", " .. \n", "x", "é" * 10_000])
    assert list(got[:3]) == [0, 0, 0]
    assert ((got >= 0) & (got <= 1)).all()
    assert (toxicity.train([], []).score(["a b"]) <= 0.5).all()
    assert (toxicity.train(["a"], [1]).score(["a b"]) <= 0.5).all()


def test_gradients_against_differences():
    net = toxicity.train(*corpus(60, 4), epochs=1)
    rng = np.random.default_rng(0)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    found = net.inputs([*list(net.word_ids)[:29], "unknown"])
    at = rng.integers(0, 30, (3, 6))
    mask, y = np.arange(6) < np.array([[6], [4], [1]]), np.array([1.0, 0.0, 1.0])
    grads = toxicity._gradients(net, found, at, mask, y)

    def loss() -> float:
        vec = net.vectors(*found)[at]
        logit = net.pool(net.states(net.project(vec, mask), mask.astype(np.float64)), mask)[3]
        q = 1 / (1 + np.exp(-logit.astype(np.float64)))
        return float(-(y * np.log(q) + (1 - y) * np.log(1 - q)).mean())

    for k in ("w", "u", "un", "att", "out", "bias", "b"):
        flat = net.p[k].reshape(-1)
        for i in rng.integers(0, flat.size, 4):
            was, eps = flat[i], 1e-2
            flat[i] = was + eps
            up = loss()
            flat[i] = was - eps
            down = loss()
            flat[i] = was
            assert abs((up - down) / (2 * eps) - grads[k].reshape(-1)[i]) < 2e-3, k


def test_spark_scores_equal_the_network(spark):
    texts, labels = corpus(200, 2)
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate([*texts, None, ""])], "doc_id bigint, text string, toxic string")
    marks = spark.createDataFrame([(i, y, 0.5) for i, y in enumerate(labels)] + [(0, None, 0.1), (None, 1, 0.1)], "doc_id bigint, toxic int, score double")
    got = docs.select("doc_id", "text", toxicity.toxicity(docs, marks).alias("s")).collect()
    net = toxicity.fit(docs, marks)
    assert np.allclose([r.s for r in got], net.score([r.text for r in got]), atol=1e-5)
    none = docs.select(toxicity.toxicity(docs, marks.limit(0)).alias("s")).collect()
    assert all(0 <= r.s < 0.5 for r in none)
    assert docs.limit(0).select(toxicity.toxicity(docs, marks).alias("s")).count() == 0
