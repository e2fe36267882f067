"""Language identification by prediction by partial matching (PPM) over bytes."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fernlog.llm.common import discard, fold, in_pieces, pieces, stored

_LETTER = regex.compile(r"\p{L}")
#: Longest context, in bytes.
ORDER = 4
#: A context or continuation is in a language's tree if it makes up this share of its bytes, so that a tree has at most
#: (ORDER + 1) / SHARE nodes, by arithmetic and whatever the corpus is.
SHARE = 2.0**-18
#: Bytes of text that a step works on.
_STEP = 1 << 20
#: Partial sums that a task keeps before it merges them, and at half of which it hands them on.
_HELD = 1 << 20
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_PAD = b" " * ORDER


def prepared(text: str) -> bytes:
    """UTF-8 bytes with A-Z in lower case, after spaces that stand for the start."""
    return _PAD + text.encode("utf-8", "replace").translate(_LOWER)


def grams(data: bytes) -> np.ndarray:
    """Each byte after the first ORDER with the ORDER bytes before it, as one number."""
    b = np.frombuffer(data, np.uint8).astype(np.int64)
    out = b[: len(b) - ORDER]
    for i in range(1, ORDER + 1):
        out = out << 8 | b[i : len(b) - ORDER + i]
    return out


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    found, where = np.unique(np.concatenate([g for g, _ in parts]), return_inverse=True)
    return found, np.bincount(where, weights=np.concatenate([n for _, n in parts])).astype(np.int64)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Numbers of the grams by language: lang, gram, n. Partial sums, flushed at a bounded size."""
    held: dict[str, list] = {}
    for batch in pieces(batches, 1, _STEP):
        texts: dict[str, list] = {}
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            texts.setdefault(lang, []).append(grams(prepared(text)))
        for lang, parts in texts.items():
            held.setdefault(lang, []).append(np.unique(np.concatenate(parts), return_counts=True))
        if sum(len(g) for parts in held.values() for g, _ in parts) > _HELD:
            held = {lang: [_merged(parts)] for lang, parts in held.items()}
            if sum(len(g) for [(g, _)] in held.values()) > _HELD // 2:
                yield from _flush(held)
    yield from _flush(held)


def _flush(held: dict[str, list]) -> Iterator[pa.RecordBatch]:
    for lang in list(held):
        found, n = _merged(held.pop(lang))
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(found), pa.string()), pa.array(found, pa.int64()), pa.array(n, pa.int64())], ["lang", "gram", "n"])


@dataclass
class Trees:
    """The languages' context trees, level by level: a node is a sequence of bytes, with the code length of its last byte in the
    context of the others; a context has the length of its escape, for each language."""

    langs: list[str]
    nodes: list[np.ndarray]  # sorted sequences of 1, 2 ... bytes
    bits: list[np.ndarray]  # (nodes, languages)
    contexts: list[np.ndarray]  # sorted sequences of 0, 1 ... bytes
    escapes: list[np.ndarray]  # (contexts, languages)
    prior: np.ndarray

    def lengths(self, texts: list[str]) -> np.ndarray:
        """Bits that each text takes under each language's frozen statistics."""
        data = [prepared(t) for t in texts]
        out = np.zeros((len(texts), len(self.langs)))
        sizes = np.array([len(d) - ORDER for d in data], np.int64)
        doc = np.repeat(np.arange(len(texts)), sizes)
        found = np.concatenate([np.zeros(0, np.int64), *map(grams, data)])
        for lo in range(0, len(found), _STEP):
            part, own = self._bits(found[lo : lo + _STEP]), doc[lo : lo + _STEP]
            starts = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
            out[own[starts]] += np.add.reduceat(part, starts, axis=0, dtype=np.float64)
        return out

    def _bits(self, found: np.ndarray) -> np.ndarray:
        """Code length of each last byte: from the longest known node, after an escape from each longer context."""
        out = np.zeros((len(found), len(self.langs)), np.float32)
        left = np.arange(len(found))
        for size in range(ORDER + 1, 0, -1):
            key = found[left] & ((1 << 8 * size) - 1)
            row, hit = _rows(self.nodes[size - 1], key)
            out[left[hit]] += self.bits[size - 1][row[hit]]
            left, key = left[~hit], key[~hit]
            if not len(left):
                return out
            row, known = _rows(self.contexts[size - 1], key >> 8)
            out[left[known]] += self.escapes[size - 1][row[known]]
        out[left] += 8
        return out


def _rows(ordered: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the keys, and which are there at all."""
    if not len(ordered):
        return np.zeros(len(key), np.int64), np.zeros(len(key), bool)
    row = np.minimum(np.searchsorted(ordered, key), len(ordered) - 1)
    return row, ordered[row] == key


def grow(counts: list[list[tuple[np.ndarray, np.ndarray]]], documents: dict[str, int]) -> Trees:
    """The trees from the counts: for each number of bytes and each language (by name) sorted nodes and their counts.

    P(byte | context) by PPM with escape method C, in the form that mixes all orders: in a context with n occurrences of q distinct
    bytes, a byte has count / (n + q), and on top q / (n + q) times its probability in the context that is one byte
    shorter. A context never seen escapes for nothing. Below the empty context all bytes are alike.
    """
    langs = sorted(documents)
    nodes, bits, contexts, escapes, before = [], [], [], [], None
    for size, level in enumerate(counts, 1):
        own = np.unique(np.concatenate([np.zeros(0, np.int64), *(g for g, _ in level)]))
        c = np.zeros((len(own), len(langs)))
        for k, (g, n) in enumerate(level):
            c[np.searchsorted(own, g), k] = n
        above, at = np.unique(own >> 8, return_inverse=True)
        n, q = np.zeros((2, len(above), len(langs)))
        np.add.at(n, at, c)
        np.add.at(q, at, c > 0)
        with np.errstate(divide="ignore", invalid="ignore"):
            escape = np.where(n > 0, q / (n + q), 1.0)
            share = np.where(n[at] > 0, c / (n + q)[at], 0.0)
        shorter = 1 / 256 if before is None else before[np.searchsorted(nodes[-1], own & ((1 << 8 * (size - 1)) - 1))]
        before = share + escape[at] * shorter
        nodes.append(own)
        bits.append(-np.log2(before).astype(np.float32))
        contexts.append(above)
        escapes.append(-np.log2(escape).astype(np.float32))
    prior = np.log2(np.array([documents[x] for x in langs], float) / sum(documents.values()))
    return Trees(langs, nodes, bits, contexts, escapes, prior)


def fit(docs: DataFrame, folds: int = 5) -> Trees | None:
    """Learn from text and non-null lang of the documents that aren't held out (crc32(doc_id as text) mod ``folds`` is 0).

    All training texts are counted, whole and exactly. Only nodes that make up at least SHARE of their language's bytes come to
    the driver; a node without its first byte is a node too, since it is at least as common.
    """
    own = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (fold(F.col("doc_id"), folds) != 0))
    documents = {r["lang"]: r["count"] for r in own.groupBy("lang").count().collect()}
    if not documents:
        return None
    found = own.select("lang", "text").mapInArrow(_count, "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    found = stored(found, "grams")
    totals = {r["lang"]: r["n"] for r in found.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    langs = sorted(documents)
    least = F.create_map(*[F.lit(x) for k in langs for x in (k, max(1.0, totals.get(k, 0) * SHARE))])
    counts: list = []
    for size in range(ORDER + 1, 0, -1):
        node = F.col("gram").bitwiseAND(F.lit((1 << 8 * size) - 1)).alias("node")
        level = found.groupBy("lang", node).agg(F.sum("n").alias("n")).where(F.col("n") >= least[F.col("lang")]).orderBy("lang", "node").toArrow()
        lang, nodes, n = np.array(level["lang"].to_pylist(), object), level["node"].to_numpy(), level["n"].to_numpy()
        counts.insert(0, [(nodes[lang == x], n[lang == x]) for x in langs])
    discard(found)
    return grow(counts, documents)


def predict(model: Trees | None, texts: list[str | None]) -> tuple[list[str], list[float]]:
    langs, scores = ["und"] * len(texts), [0.0] * len(texts)
    own = [i for i, t in enumerate(texts) if model is not None and t and _LETTER.search(t)]
    if own:
        x = model.prior - model.lengths([texts[i] for i in own])
        best = x.argmax(axis=1)
        share = 1 / np.exp2(np.maximum(x - x.max(axis=1, keepdims=True), -1000)).sum(axis=1)
        for i, b, s in zip(own, best.tolist(), share.tolist(), strict=True):
            langs[i], scores[i] = model.langs[b], s
    return langs, scores


def languages(docs: DataFrame, folds: int = 5) -> DataFrame:
    """Predicted language of every whole text: doc_id, held_out, lang_pred, score.

    For each language the bytes of its training texts are counted in contexts of up to ORDER bytes, which make a tree; a text
    goes to the language under which its code, with these statistics frozen, is shortest (with the share of the training
    documents as the prior). score is that language's probability. ``docs`` has doc_id, text, lang; other columns are ignored
    and lang only serves to learn.

    Texts that are null or have no letter get ``und`` and score 0, as do all when there is nothing to learn from. Of
    equally short codes the first language by name wins. Null doc_ids are held out. Repeated rows count again in learning.
    """
    held = docs.sparkSession.sparkContext.broadcast(fit(docs, folds))

    @F.arrow_udf("struct<lang string, score double>")
    def of(texts: pa.Array) -> pa.Array:
        found = [predict(held.value, part.to_pylist()) for part in in_pieces(texts, _STEP)]
        langs, scores = [x for f, _ in found for x in f], [x for _, f in found for x in f]
        return pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["lang", "score"])

    found = docs.select("doc_id", (fold(F.col("doc_id"), folds) == 0).alias("held_out"), of(F.col("text")).alias("_p"))
    return found.select("doc_id", "held_out", F.col("_p.lang").alias("lang_pred"), F.col("_p.score").alias("score"))
