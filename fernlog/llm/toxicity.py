"""Toxicity by a bidirectional gated recurrent network with attention pooling, trained and run in numpy."""

from __future__ import annotations

import math
import re
from collections.abc import Iterable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fernlog.llm.common import fold, in_pieces

_TOKEN = re.compile(r"[^\W_]+")
#: Windows of so many tokens, so many apart: all overlap by a quarter.
WINDOW, STRIDE = 48, 36
#: Sizes of the word vector, the character vector and each direction's state.
_DW, _DC, _H = 4, 4, 8
_STEP = 2_048
#: Words whose input vectors a task keeps; then it begins anew.
_KEPT = 200_000


def tokens(text: str | None) -> list[str]:
    return _TOKEN.findall(text.lower()) if text else []


def grams(word: str, n: int = 4) -> list[str]:
    """Character n-grams with marked ends."""
    w = f"<{word}>"
    return [w[i : i + n] for i in range(max(1, len(w) - n + 1))]


def windows(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of texts laid end to end: document, start and length of each window; a text without tokens has none."""
    n = np.where(lengths > 0, 1 + -(-np.maximum(lengths - WINDOW, 0) // STRIDE), 0)
    doc = np.repeat(np.arange(len(lengths)), n)
    k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    base = (np.cumsum(lengths) - lengths)[doc]
    return doc, base + k * STRIDE, np.minimum(WINDOW, lengths[doc] - k * STRIDE)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class Network:
    """Word and character tables, and the weights ``p`` of the network."""

    word_ids: dict[str, int]
    gram_ids: dict[str, int]
    p: dict[str, np.ndarray]
    cache: dict[str, int] = field(default_factory=dict, repr=False)

    def inputs(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows of the words (0: unknown), and the number and rows of their known character n-grams."""
        get = self.gram_ids.get
        own = [[g for x in grams(w) if (g := get(x)) is not None] for w in words]
        ids = np.fromiter((self.word_ids.get(w, 0) for w in words), np.int64, len(words))
        counts = np.fromiter(map(len, own), np.int64, len(words))
        return ids, counts, np.fromiter((g for x in own for g in x), np.int64, counts.sum())

    def vectors(self, ids: np.ndarray, counts: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Input vectors of words: word vector, mean of the n-gram vectors, largest first entry of these."""
        out = np.zeros((len(ids), _DW + _DC + 1), self.p["word"].dtype)
        out[:, :_DW] = self.p["word"][ids]
        if len(rows):
            own, some = self.p["char"][rows], counts > 0
            at = (np.cumsum(counts) - counts)[some]
            out[some, _DW : _DW + _DC] = np.add.reduceat(own, at) / counts[some][:, None]
            out[some, -1] = np.maximum(np.maximum.reduceat(own[:, 0], at), 0)
        return out

    def states(self, x: np.ndarray, mask: np.ndarray, keep: bool = False):
        """Outputs (T, 2, B, H) of both directions over projected inputs (T, 2, B, 3H), the second one reversed in time."""
        p, (t, _, b, _) = self.p, x.shape
        h = np.zeros((2, b, _H), np.float32)
        out, tape = np.empty((t, 2, b, _H), np.float32), []
        for i in range(t):
            m = np.stack([mask[:, i], mask[:, t - 1 - i]])[:, :, None]
            zr = _sigmoid(x[i, :, :, : 2 * _H] + h @ p["u"])
            z, r = zr[:, :, :_H] * m, zr[:, :, _H:]
            n = np.tanh(x[i, :, :, 2 * _H :] + (r * h) @ p["un"])
            if keep:
                tape.append((h, z, r, n, m))
            h = h + z * (n - h)
            out[i] = h
        return (out, tape) if keep else out

    def project(self, vec: np.ndarray, mask: np.ndarray) -> np.ndarray:
        """Projected inputs, time first, second direction reversed; vec is (B, T, D)."""
        f = np.einsum("btd,dk->tbk", vec, self.p["w"][0], optimize=True) + self.p["b"][0]
        g = np.einsum("btd,dk->tbk", vec[:, ::-1], self.p["w"][1], optimize=True) + self.p["b"][1]
        return np.stack([f, g], axis=1)

    def pool(self, out: np.ndarray, mask: np.ndarray):
        """Attention over (B, T, 2H) outputs: weights, pooled states, logits."""
        seq = np.concatenate([out[:, 0], out[::-1, 1]], axis=2).transpose(1, 0, 2)
        e = np.where(mask, seq @ self.p["att"], np.float32(-1e9))
        a = np.exp(e - e.max(axis=1, keepdims=True))
        a /= a.sum(axis=1, keepdims=True)
        pooled = np.einsum("bt,btk->bk", a, seq)
        return seq, a, pooled, pooled @ self.p["out"] + self.p["bias"][0]

    def logits(self, ids: np.ndarray, table: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Logit of each window; ``table`` holds the projected inputs (both directions) of the words in ``ids``."""
        scores = np.empty(len(starts), np.float32)
        for lo in range(0, len(starts), _STEP):
            s, n = starts[lo : lo + _STEP], sizes[lo : lo + _STEP]
            mask = np.arange(WINDOW) < n[:, None]
            at = ids[np.minimum(s[:, None] + np.arange(WINDOW), len(ids) - 1)]
            x = np.stack([table[at.T, 0], table[at.T[::-1], 1]], axis=1)
            scores[lo : lo + _STEP] = self.pool(self.states(x, mask.astype(np.float32)), mask)[3]
        return scores

    def table(self, vec: np.ndarray) -> np.ndarray:
        return np.stack([vec @ self.p["w"][0] + self.p["b"][0], vec @ self.p["w"][1] + self.p["b"][1]], axis=1).astype(np.float32)

    def score(self, texts: list[str | None]) -> np.ndarray:
        """Highest probability of a document's windows; 0 for a text without letters or digits."""
        if len(self.cache) > _KEPT or not hasattr(self, "rows"):
            self.cache, self.rows = {}, np.zeros((0, 2, 3 * _H), np.float32)
        lists = [tokens(t) for t in texts]
        flat = [w for x in lists for w in x]
        new = list(dict.fromkeys(w for w in dict.fromkeys(flat) if w not in self.cache))
        if new:
            self.cache.update(zip(new, range(len(self.cache), len(self.cache) + len(new)), strict=True))
            self.rows = np.concatenate([self.rows, self.table(self.vectors(*self.inputs(new)))])
        ids = np.fromiter(map(self.cache.__getitem__, flat), np.int32, len(flat))
        doc, starts, sizes = windows(np.array([len(x) for x in lists], np.int64))
        out = np.zeros(len(texts))
        if len(doc):
            np.maximum.at(out, doc, _sigmoid(self.logits(ids, self.rows, starts, sizes).astype(np.float64)))
        return out


def _odds(names: list[str], toxic: np.ndarray, rest: np.ndarray, n1: int, n0: int, least: int, most: int) -> dict[str, float]:
    """Smoothed log-odds of the commonest entries by the numbers of toxic and other texts that hold them."""
    both = toxic + rest
    found = sorted(np.flatnonzero(both >= least), key=lambda i: (-both[i], names[i]))[:most]
    return {names[i]: math.log((toxic[i] + 1) / (n1 + 2)) - math.log((rest[i] + 1) / (n0 + 2)) for i in found}


def train(texts: Iterable[str], labels: list[int], epochs: int = 6, rate: float = 0.01, batch: int = 128, least_steps: int = 200, seed: int = 1, max_words: int = 50_000, max_grams: int = 50_000) -> Network:
    """Fit the network on labelled texts. Word and n-gram vectors start from log-odds in one half of the texts; the
    network is fitted on the other half, where each text counts through its highest window, for ``epochs`` or ``least_steps`` batches,
    whichever is more. Texts are held as numbers of words."""
    rng = np.random.default_rng(seed)
    vocab: dict[str, int] = {}
    ids = [np.array([vocab.setdefault(w, len(vocab)) for w in tokens(t)], np.int32) for t in texts]
    y = np.array(labels, np.float32)
    half = rng.permutation(len(ids)) % 2 == 0
    names, of_gram = list(vocab), {}
    own = [np.array([of_gram.setdefault(g, len(of_gram)) for g in grams(w)], np.int32) for w in names]
    with_word, with_gram = np.zeros((2, len(names)), np.int64), np.zeros((2, len(of_gram)), np.int64)
    for i in np.flatnonzero(half):
        used = np.unique(ids[i])
        with_word[int(y[i]), used] += 1
        if len(used):
            with_gram[int(y[i]), np.unique(np.concatenate([own[w] for w in used]))] += 1
    n1 = int(y[half].sum())
    n0 = int(half.sum()) - n1
    words = _odds(names, with_word[1], with_word[0], n1, n0, 3, max_words)
    chars = _odds(list(of_gram), with_gram[1], with_gram[0], n1, n0, 5, max_grams)
    del own, of_gram, with_word, with_gram

    def start(odds: dict[str, float], unknown: int, d: int) -> np.ndarray:
        out = rng.normal(0, 0.05, (len(odds) + unknown, d)).astype(np.float32)
        out[unknown:, 0] = list(odds.values())
        out[:unknown] = 0
        return out

    d = _DW + _DC + 1
    p = {"word": start(words, 1, _DW), "char": start(chars, 0, _DC) if chars else np.zeros((1, _DC), np.float32)}
    shapes = {"w": (2, d, 3 * _H), "u": (2, _H, 2 * _H), "un": (2, _H, _H), "att": (2 * _H,), "out": (2 * _H,)}
    p |= {k: rng.normal(0, 0.25, s).astype(np.float32) for k, s in shapes.items()}
    p |= {"b": np.zeros((2, 1, 3 * _H), np.float32), "bias": np.array([-2.0], np.float32)}
    net = Network({w: i + 1 for i, w in enumerate(words)}, {g: i for i, g in enumerate(chars)}, p)
    second = np.flatnonzero(~half & np.array([len(x) > 0 for x in ids], bool))
    if not len(second):
        return net
    used, flat = np.unique(np.concatenate([ids[i] for i in second]), return_inverse=True)
    ids = np.split(flat.astype(np.int32), np.cumsum([len(ids[i]) for i in second])[:-1])
    found = net.inputs([names[i] for i in used])
    del vocab, names, flat
    epochs = max(epochs, -(-least_steps * batch // len(second)))
    m, v, step = {}, {}, 0
    for epoch in range(epochs):
        order = rng.permutation(len(second))
        for lo in range(0, len(order), batch):
            part = order[lo : lo + batch]
            if step % 8 == 0:  # the inputs of all words are brought up to date now and then
                table = net.table(net.vectors(*found))
            flat = np.concatenate([ids[i] for i in part])
            doc, starts, sizes = windows(np.array([len(ids[i]) for i in part]))
            scores = net.logits(flat, table, starts, sizes)
            best = np.lexsort((scores, doc))
            best = best[np.append(np.flatnonzero(np.diff(doc[best])), len(best) - 1)]
            mask = np.arange(WINDOW) < sizes[best][:, None]
            at = flat[np.minimum(starts[best][:, None] + np.arange(WINDOW), len(flat) - 1)]
            grads = _gradients(net, found, at, mask, y[second[part]])
            step += 1
            lr = rate * (1 - 0.8 * epoch / epochs)
            for k, g in grads.items():
                m[k] = 0.9 * m.get(k, 0) + 0.1 * g
                v[k] = 0.999 * v.get(k, 0) + 0.001 * g * g
                p[k] -= (lr * (0.1 if k in ("word", "char") else 1) * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-6)).astype(np.float32)
    return net


def _gradients(net: Network, found: tuple, at: np.ndarray, mask: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
    """Gradients of the mean cross-entropy of windows, by backpropagation through time; ``at`` (B, T) has places in ``found``."""
    p, (b, t) = net.p, mask.shape
    ids, counts, rows = found
    used, where = np.unique(at, return_inverse=True)
    begin, many = (np.cumsum(counts) - counts)[used], counts[used]
    flat = rows[np.repeat(begin - (np.cumsum(many) - many), many) + np.arange(many.sum())]
    vec = net.vectors(ids[used], many, flat)[where.reshape(b, t)]
    out, tape = net.states(net.project(vec, mask), mask.astype(np.float32), keep=True)
    seq, a, pooled, logit = net.pool(out, mask)
    dl = (_sigmoid(logit) - y) / b
    g = {"out": pooled.T @ dl, "bias": np.array([dl.sum()])}
    dp = dl[:, None] * p["out"]
    da = np.einsum("bk,btk->bt", dp, seq)
    de = a * (da - (a * da).sum(axis=1, keepdims=True))
    g["att"] = np.einsum("bt,btk->k", de, seq)
    dseq = a[:, :, None] * dp[:, None, :] + de[:, :, None] * p["att"]
    dout = np.stack([dseq[:, :, :_H].transpose(1, 0, 2), dseq[:, ::-1, _H:].transpose(1, 0, 2)], axis=1)
    g |= {"u": np.zeros_like(p["u"]), "un": np.zeros_like(p["un"])}
    dx = np.zeros((t, 2, b, 3 * _H), np.float32)
    dh = np.zeros((2, b, _H), np.float32)
    for i in range(t - 1, -1, -1):
        h, z, r, n, m = tape[i]
        dh = dh + dout[i]
        dn = dh * z * (1 - n * n)
        zz = z  # already masked; its own slope is that of the sigmoid where the mask is 1
        dz = dh * (n - h) * zz * (1 - zz)
        drh = dn @ p["un"].transpose(0, 2, 1)
        dr = drh * h * r * (1 - r)
        dzr = np.concatenate([dz, dr], axis=2)
        dx[i] = np.concatenate([dzr, dn], axis=2)
        g["u"] += h.transpose(0, 2, 1) @ dzr
        g["un"] += (r * h).transpose(0, 2, 1) @ dn
        dh = dh * (1 - z) + dzr @ p["u"].transpose(0, 2, 1) + drh * r
    f, rev = dx[:, 0].transpose(1, 0, 2), dx[::-1, 1].transpose(1, 0, 2)
    g["w"] = np.stack([np.einsum("btd,btk->dk", vec, f, optimize=True), np.einsum("btd,btk->dk", vec, rev, optimize=True)])
    g["b"] = np.stack([f.sum(axis=(0, 1)), rev.sum(axis=(0, 1))])[:, None, :]
    dvec = np.zeros((len(used), _DW + _DC + 1))
    np.add.at(dvec, where.ravel(), (f @ p["w"][0].T + rev @ p["w"][1].T).reshape(b * t, -1))
    g["word"], g["char"] = np.zeros_like(p["word"]), np.zeros_like(p["char"])
    np.add.at(g["word"], ids[used], dvec[:, :_DW])
    g["word"][0] = 0
    own = np.repeat(np.arange(len(used)), many)
    np.add.at(g["char"], flat, dvec[own, _DW : _DW + _DC] / np.maximum(many, 1)[own][:, None])
    return g


def labelled_sample(docs: DataFrame, labels: DataFrame, folds: int = 5, sample: int = 6_000, max_chars: int = 50_000) -> DataFrame:
    """About ``sample`` labelled training texts, chosen by a hash of doc_id, one for each id (the first by text): doc_id, text, toxic.

    Rows whose crc32(doc_id as text) mod ``folds`` is 0 are held out. Null labels and ids are left out, of several labels
    of a document the largest counts, and texts above ``max_chars`` are not trained on (they are scored whole).
    """
    own = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & (fold(F.col("doc_id"), folds) != 0))
    own = own.groupBy(F.col("doc_id").alias("id")).agg(F.max("toxic").alias("toxic"))
    part = min(1.0, sample / max(1, own.count()))
    chosen = own.where(F.pmod(F.xxhash64("id", F.lit("sample")), F.lit(1_000_000)) < int(part * 1_000_000))
    texts = docs.where(F.char_length("text") <= max_chars).select("doc_id", "text")
    # the chosen labels are bounded by the sample's size
    found = texts.join(F.broadcast(chosen), F.col("doc_id") == F.col("id"))
    return found.groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic"))


def fit(docs: DataFrame, labels: DataFrame, folds: int = 5, sample: int = 6_000) -> Network:
    """Train on the bounded sample; the same input gives the same network. Without labels all texts score low."""
    rows = labelled_sample(docs, labels, folds, sample).toArrow().sort_by([("doc_id", "ascending"), ("text", "ascending")])
    return train((t.as_py() for t in rows["text"]), [int(x == 1) for x in rows["toxic"].to_pylist()])


def scorer(spark, net: Network):
    """A function from a text column to its score; the network is sent to each executor once (tables of bounded size)."""
    held = spark.sparkContext.broadcast(net)

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        found = [held.value.score(part.to_pylist()) for part in in_pieces(texts)]
        return pa.array(np.concatenate([np.zeros(0), *found]))

    return score


def toxicity(docs: DataFrame, labels: DataFrame, folds: int = 5, sample: int = 6_000) -> Column:
    """Score in [0, 1] of ``docs.text`` as a column, higher when a label 1 is likelier: the highest window's probability.

    ``docs`` has doc_id and text, ``labels`` doc_id and toxic; other columns are ignored. Whole texts are scored, however
    long, in windows of WINDOW words that start every STRIDE words: each word is in one or two windows, and a passage of up to
    WINDOW - STRIDE + 1 words is whole in one at least. Null and empty texts and texts without letters or digits score 0. Equal texts score alike. Empty tables give
    an empty result, and a network that has seen no label.
    """
    return scorer(docs.sparkSession, fit(docs, labels, folds, sample))(F.col("text"))
