"""Language-model scoring with a log-bilinear model trained by noise-contrastive estimation."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fernlog.llm.common import fold, pieces, stored

#: The end of a text; no word holds a line feed.
END = b"\n"
#: Least units that the network predicts (0: end, last: any other), size of their vectors, units of context.
UNITS, DIM, CONTEXT = 256, 16, 2
#: Weight of an unseen word in a word count.
ADD = 0.1
_BATCH, _NOISE, _RATIO = 4_096, 48, 16.0
#: Distinct words that a counting task keeps before it hands its sums on.
_HELD = 200_000
#: Scores that are held at once, sums of contexts that a task remembers, and weights of a row of the average.
_SCORES, _SUMS, _PIECE = 1 << 22, 1 << 24, 1 << 14


def tokens(text: bytes | None) -> list[bytes]:
    """Words (A-Z in lower case), then the end."""
    return [*(text or b"").lower().split(), END]  # bytes: ASCII case, and splits at \x20 and \x09-\x0D


def suffix(word: bytes) -> bytes:
    return word[-3:]


def unit_count(kinds: int) -> int:
    """Units for so many distinct words: the square root, so that units and words in a unit grow alike; at least UNITS."""
    return max(UNITS, math.isqrt(kinds))


def heads(units: int) -> int:
    """Units that are single words, the commonest; the others are endings of the rarer words."""
    return units // 4


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: Counter = Counter()

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.binary()), pa.array(held.values(), pa.int64())], ["word", "n"])

    for batch in pieces(batches, 0):
        for text in batch.column(0).to_pylist():
            held.update(tokens(text))
            if len(held) > _HELD:
                yield out()
                held.clear()
    yield out()


def word_counts(texts: DataFrame) -> DataFrame:
    """Exact counts of all words and ends of a binary column: word, c. Summed by task before the shuffle."""
    return texts.mapInArrow(_count, "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("c"))


@dataclass
class LogBilinear:
    """Vectors of context units ``r``, matrices ``m`` of the positions, vectors ``t`` and biases ``b`` of predicted units."""

    r: np.ndarray
    m: np.ndarray
    t: np.ndarray
    b: np.ndarray
    noise: np.ndarray
    slopes: dict[str, np.ndarray] = field(default_factory=dict, repr=False)
    sums: np.ndarray | None = field(default=None, repr=False)

    @classmethod
    def start(cls, counts: np.ndarray, seed: int = 3) -> LogBilinear:
        rng, share = np.random.default_rng(seed), (counts + 1) / (counts.sum() + len(counts))
        r = rng.normal(0, 0.1, (len(counts), DIM)).astype(np.float32)
        m = np.stack([np.eye(DIM, dtype=np.float32)] * CONTEXT)
        return cls(r, m, rng.normal(0, 0.1, r.shape).astype(np.float32), np.log(share).astype(np.float32), share)

    def flat(self) -> np.ndarray:
        return np.concatenate([x.ravel() for x in (self.r, self.m, self.t, self.b)])

    def load(self, flat: np.ndarray) -> LogBilinear:
        out, at = [], 0
        for x in (self.r, self.m, self.t, self.b):
            out.append(flat[at : at + x.size].reshape(x.shape).astype(np.float32))
            at += x.size
        return LogBilinear(*out, self.noise)

    def log_probabilities(self, context: np.ndarray, units: np.ndarray) -> np.ndarray:
        """log10 P(unit | context), normalised over all units.

        The sum over the units is a matrix product for many contexts at once. It depends on the context alone, so that it is
        worked out once for each distinct one and remembered where the table of all contexts is of bounded size.
        """
        n, tables = len(self.b), [self.r @ m for m in self.m]
        codes = context[:, 0].astype(np.int64)
        for i in range(1, CONTEXT):
            codes = codes * n + context[:, i]
        if n**CONTEXT <= _SUMS:
            if self.sums is None:
                self.sums = np.full(n**CONTEXT, np.nan, np.float32)
            sums, where = self.sums, codes
            missing = np.unique(codes[np.isnan(sums[codes])])
            sums[missing] = self._log_sums(missing, tables)
        else:
            missing, where = np.unique(codes, return_inverse=True)
            sums = self._log_sums(missing, tables)
        q = sum(tables[i][context[:, i]] for i in range(CONTEXT))
        own = np.einsum("nd,nd->n", q, self.t[units]) + self.b[units]
        return (own.astype(np.float64) - sums[where]) / np.log(10)

    def _log_sums(self, codes: np.ndarray, tables: list[np.ndarray]) -> np.ndarray:
        """The logarithm of the sum of exp(score) over all units, for each context."""
        n, out = len(self.b), np.empty(len(codes), np.float32)
        # scores are as a rule far from what float32 can't exponentiate: only else the largest is taken off first
        length = sum(np.sqrt((x**2).sum(axis=1)).max() for x in tables) * np.sqrt((self.t**2).sum(axis=1)).max()
        far = length + np.abs(self.b).max() > 60
        step = max(64, _SCORES // n)
        for lo in range(0, len(codes), step):
            c, q = codes[lo : lo + step], 0
            for i in range(CONTEXT - 1, -1, -1):
                q, c = q + tables[i][c % n], c // n
            s = q @ self.t.T + self.b
            top = s.max(axis=1, keepdims=True) if far else np.float32(0)
            if far:
                s -= top
            out[lo : lo + step] = np.log(np.exp(s, out=s).sum(axis=1)) + np.ravel(top)
        return out

    def learn(self, context: np.ndarray, units: np.ndarray, rng: np.random.Generator, rate: float) -> None:
        """One pass of noise-contrastive steps (Adagrad). A batch shares its noise units; each stands for _RATIO / _NOISE draws.

        A step touches only the vectors of the units in its batch, so that its cost doesn't grow with the number of units.
        """
        logs, cdf = np.log(_RATIO * self.noise).astype(np.float32), np.cumsum(self.noise)
        if not self.slopes:
            self.slopes = {k: np.full(getattr(self, k).shape, 1e-8, np.float32) for k in "rmtb"}

        place = np.zeros(len(cdf), np.int64)

        def numbered(found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """The distinct units, and the place of each of ``found`` among them."""
            place[found] = -1
            rows = np.flatnonzero(place < 0)
            place[rows] = np.arange(len(rows))
            return rows, place[found]

        def scattered(rows: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
            return np.stack([np.bincount(rows, weights=v, minlength=n) for v in values.T], axis=1).astype(np.float32)

        def step(name: str, g: np.ndarray, rows: np.ndarray | slice = slice(None)) -> None:
            g = g / size
            h = self.slopes[name][rows] + g * g
            self.slopes[name][rows] = h
            getattr(self, name)[rows] += rate * g / np.sqrt(h)

        order = rng.permutation(len(units))
        for lo in range(0, len(order), _BATCH):
            part = order[lo : lo + _BATCH]
            size = np.float32(len(part))
            drawn = np.minimum(np.searchsorted(cdf, rng.random(_NOISE)), len(cdf) - 1)
            seen, at = numbered(context[part])
            outs, of = numbered(np.concatenate([units[part], drawn]))
            u, d = of[: len(part)], of[len(part) :]
            vec, t, b, k = self.r[seen], self.t[outs], self.b[outs], logs[outs]
            q = sum((vec @ self.m[i])[at[:, i]] for i in range(CONTEXT))
            tu = t[u]
            own = 1 / (1 + np.exp(np.clip(np.einsum("nd,nd->n", q, tu) + (b - k)[u], -30, 30)))  # 1 - sigmoid
            s = q @ t[d].T
            s += (b - k)[d]
            np.clip(s, -30, 30, out=s)
            np.exp(np.negative(s, out=s), out=s)
            s += 1
            other = np.divide(np.float32(-_RATIO / _NOISE), s, out=s)
            dq = own[:, None] * tu + other @ t[d]
            dt = scattered(u, own[:, None] * q, len(outs))
            np.add.at(dt, d, other.T @ q)
            db = np.bincount(u, weights=own, minlength=len(outs)).astype(np.float32)
            np.add.at(db, d, other.sum(axis=0))
            dp = [scattered(at[:, i], dq, len(seen)) for i in range(CONTEXT)]
            dr = sum(dp[i] @ self.m[i].T for i in range(CONTEXT))
            step("m", np.stack([vec.T @ dp[i] for i in range(CONTEXT)]))
            step("r", dr, seen)
            step("t", dt, outs)
            step("b", db, outs)


@dataclass
class Vocabulary:
    """The commonest words with their logarithms, and the units of all words; of bounded size."""

    words: dict[bytes, int]
    logs: np.ndarray  # log10(c + ADD) of the words
    of_word: np.ndarray  # their units
    heads: dict[bytes, int]  # units that are single words
    units: dict[bytes, int]  # units of the other words, by suffix
    sizes: np.ndarray  # tokens of each unit
    kinds: np.ndarray  # distinct words of each unit

    def unit(self, word: bytes) -> int:
        found = self.heads.get(word)
        return self.units.get(suffix(word), len(self.sizes) - 1) if found is None else found

    def stream(self, texts: list[bytes | None]) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray]:
        """Of texts laid end to end: all tokens, place of each in ``words`` or -1, unit, and tokens of each text."""
        lists = [tokens(t) for t in texts]
        flat = [w for x in lists for w in x]
        places = np.fromiter(map(self.words.get, flat, repeat(-1)), np.int32, len(flat))
        units = self.of_word[places] if len(self.of_word) else np.zeros(len(flat), np.int32)
        rest = np.flatnonzero(places < 0)
        units[rest] = [self.unit(flat[i]) for i in rest]
        return flat, places, units, np.fromiter(map(len, lists), np.int64, len(lists))


def contexts(units: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Of texts laid end to end: the units before each token, the nearest first; before a text stands its end."""
    at = np.arange(len(units)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out = np.zeros((len(units), CONTEXT), np.int32)
    for i in range(CONTEXT):
        before = np.flatnonzero(at > i)
        out[before, i] = units[before - i - 1]
    return out


def _vocabulary(counts: DataFrame, head: int, most: int) -> tuple[Vocabulary, int]:
    """The vocabulary of at most ``most`` units, and the count from which a word is in it."""
    spark = counts.sparkSession
    words = counts.where(F.col("word") != F.lit(END))
    single = [bytes(r["word"]) for r in words.orderBy(F.desc("c"), "word").limit(heads(most)).collect()]
    own = {END: 0} | {w: i + 1 for i, w in enumerate(single)}
    # units of the rest: the commonest suffixes; single words and suffixes are at most ``most`` rows
    tail = F.col("word").substr(F.greatest(F.octet_length("word") - 2, F.lit(1)), F.lit(3))
    rest = words.join(F.broadcast(spark.createDataFrame([(bytearray(w),) for w in single], "word binary")), "word", "left_anti")
    top = rest.groupBy(tail.alias("s")).agg(F.sum("c").alias("n")).orderBy(F.desc("n"), "s").limit(most - len(own) - 1).collect()
    units = {bytes(r["s"]): i + len(own) for i, r in enumerate(top)}
    n_units = max(UNITS, len(own) + len(units) + 1)
    other = n_units - 1

    @F.arrow_udf("int")
    def unit_of(found: pa.Array) -> pa.Array:
        return pa.array([units.get(suffix(w), other) if (u := own.get(w)) is None else u for w in found.to_pylist()], pa.int32())

    by_unit = counts.groupBy(unit_of("word").alias("u")).agg(F.sum("c").alias("n"), F.count("*").alias("k")).collect()
    sizes, kinds = np.zeros(n_units, np.int64), np.zeros(n_units, np.int64)
    for r in by_unit:
        sizes[r["u"]], kinds[r["u"]] = r["n"], r["k"]
    # the words that fit: from a histogram of the counts, in steps of a sixteenth of a power of two
    steps = counts.groupBy(F.floor(F.log2("c") * 16).alias("step")).agg(F.count("*").alias("k"), F.min("c").alias("low")).collect()
    least, room = 1 << 62, head
    for r in sorted(steps, key=lambda r: -r["step"]):
        room -= r["k"]
        if room < 0:
            break
        least = r["low"]
    rows = counts.where(F.col("c") >= least).toArrow()
    known, c = rows["word"].to_pylist(), rows["c"].to_numpy()
    order = np.argsort(np.array(known, object)) if known else []
    known = [known[i] for i in order]
    voc = Vocabulary({w: i for i, w in enumerate(known)}, np.log10(c[order] + ADD) if len(order) else np.zeros(0), np.zeros(len(known), np.int32), own, units, sizes, kinds)
    voc.of_word = np.array([voc.unit(w) for w in known], np.int32)
    return voc, least


@dataclass
class Model:
    vocabulary: Vocabulary
    network: LogBilinear
    counts: DataFrame
    least: int
    tokens: int
    kinds: int
    walked: DataFrame | None = None


_WALKED = "piece int, seen bigint, doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, logs double, body binary, words array<binary>, times array<int>"
_KINDS = {"piece": pa.int32(), "held_out": pa.bool_(), "logs": pa.float64(), "body": pa.binary(), "words": pa.list_(pa.binary()), "times": pa.list_(pa.int32())}
_NAMES = [x.split()[0] for x in _WALKED.split(", ")]
_MEAN = "piece int, seen bigint, body binary"


def _filled(n: int, **columns) -> pa.RecordBatch:
    """A batch of ``n`` rows; columns that aren't given are null."""
    kinds = {k: _KINDS.get(k, pa.int64()) for k in _NAMES}
    return pa.RecordBatch.from_arrays([columns[k] if isinstance(columns.get(k), pa.Array) else pa.array(columns.get(k, [None] * n), kinds[k]) for k in _NAMES], _NAMES)


def _walk(docs: DataFrame, voc: Vocabulary, net: LogBilinear | None = None, first: float = 0.0, last: float = 0.0, rows: bool = True) -> DataFrame:
    """One walk over texts: with ``rows`` a row for each document, with its units; with a network each task's weights.

    A task starts from the network and learns from every token of its documents that aren't held out; the rate falls from
    ``first`` to ``last`` over 2 M tokens. Its weights are rows with a ``piece`` number.
    """
    held = docs.sparkSession.sparkContext.broadcast((voc, net))

    def passed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        voc, begun = held.value
        kind = np.min_scalar_type(len(voc.sizes))
        if begun:
            own, seen, draw = begun.load(begun.flat()), 0, np.random.default_rng(5)
        for batch in pieces(batches, 2):
            flat, places, units, sizes = voc.stream(batch.column(2).to_pylist())
            doc, n, known = np.repeat(np.arange(len(sizes)), sizes), len(sizes), places >= 0
            if begun:
                learnt = ~batch.column(1).to_numpy(zero_copy_only=False).astype(bool)[doc]
                own.learn(contexts(units, sizes)[learnt], units[learnt], draw, max(last, first - (first - last) * seen / 2e6))
                seen += int(learnt.sum())
            if not rows:
                continue
            rest: list[dict] = [{} for _ in range(n)]
            for i, d in zip(np.flatnonzero(~known).tolist(), doc[~known].tolist(), strict=True):
                rest[d][flat[i]] = rest[d].get(flat[i], 0) + 1
            ends = np.cumsum(sizes)
            body = units.astype(kind)
            yield _filled(
                n,
                doc_id=batch.column(0),
                held_out=batch.column(1),
                n_tokens=pa.array(sizes, pa.int64()),
                n_known=pa.array(np.bincount(doc[known], minlength=n), pa.int64()),
                logs=pa.array(np.bincount(doc[known], weights=voc.logs[places[known]], minlength=n), pa.float64()),
                body=pa.array([body[e - k : e].tobytes() for k, e in zip(sizes.tolist(), ends.tolist(), strict=True)], pa.binary()),
                words=pa.array([list(x) for x in rest], pa.list_(pa.binary())),
                times=pa.array([list(x.values()) for x in rest], pa.list_(pa.int32())),
            )
        if begun and seen:
            weights = own.flat().astype(np.float32)
            parts = [weights[i : i + _PIECE].tobytes() for i in range(0, len(weights), _PIECE)]
            yield _filled(len(parts), piece=range(len(parts)), seen=[seen] * len(parts), body=parts)

    return docs.select("doc_id", "held_out", "text").mapInArrow(passed, _WALKED)


def _averaged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Means of the pieces by tokens, summed as they come."""
    sums: dict[int, list] = {}
    for batch in batches:
        for piece, seen, weights in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            own = sums.setdefault(piece, [0, 0.0])
            own[0], own[1] = own[0] + seen, own[1] + seen * np.frombuffer(weights, np.float32).astype(np.float64)
    means = [(x / n).astype(np.float32).tobytes() for n, x in sums.values()]
    yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([n for n, _ in sums.values()], pa.int64()), pa.array(means, pa.binary())], ["piece", "seen", "body"])


def _mean(net: LogBilinear, walked: DataFrame) -> LogBilinear:
    """The network with the mean of all tasks' weights, by tokens; pieces are averaged where they are shuffled to."""
    pieces = walked.where("piece IS NOT NULL").select("piece", "seen", "body").repartition("piece").mapInArrow(_averaged, _MEAN).collect()
    parts = sorted(pieces, key=lambda r: r["piece"])
    return net.load(np.concatenate([np.frombuffer(r["body"], np.float32) for r in parts])) if parts else net


def fit(docs: DataFrame, head: int = 200_000, pilot: int = 4_000) -> Model:
    """Learn from all rows of ``docs`` (doc_id, text binary) but those whose ``held_out``, if there is such a column, is true.

    All words of all texts are counted exactly. The network starts from one task's pass over a sample of about ``pilot``
    whole texts; then each task goes over all its texts from there, with every token as a target, and the tasks' weights
    are averaged, by tokens, in a shuffle. The number of units follows the distinct words. Rates don't depend on the
    input's size. The same walk leaves the units of every document in the model, from which they are scored.
    """
    held = F.coalesce("held_out", F.lit(False)) if "held_out" in docs.columns else F.lit(False)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held.alias("held_out"), "text")
    texts = docs.where(~F.col("held_out"))
    counts = stored(word_counts(texts.select("text")), "counts")
    n, kinds, many = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*"), F.coalesce(F.sum(F.when(F.col("word") == F.lit(END), F.col("c"))), F.lit(0))).first()
    voc, least = _vocabulary(counts, head, unit_count(kinds))
    part = F.pmod(F.xxhash64("doc_id", "text", F.lit("pilot")), F.lit(1_000_000)) < int(min(1.0, pilot / max(1, many)) * 1_000_000)
    net = LogBilinear.start(voc.sizes)
    net = _mean(net, _walk(texts.where(part).distinct().repartition(1).sortWithinPartitions("doc_id", "text"), voc, net, 0.1, 0.02, rows=False))
    walked = stored(_walk(docs, voc, net, 0.03, 0.03), "walked")
    return Model(voc, _mean(net, walked), counts, least, int(n), int(kinds), walked)


_SCORED = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, logs double, model double, words array<binary>, times array<int>"


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of ``docs`` (doc_id, held_out, text binary)."""
    return _scores(stored(_walk(docs.withColumn("doc_id", F.col("doc_id").cast("long")), model.vocabulary), "walked"), model)


def _scores(walked: DataFrame, model: Model) -> DataFrame:
    """Scores of documents from their units.

    P(word | context) = P(unit | context) x (c + ADD) / (tokens of the unit + ADD x (its distinct words + 1)). The counts of
    the commonest words were at hand in each task; the others are joined with the table of counts and summed by document.
    """
    held = walked.sparkSession.sparkContext.broadcast((model.vocabulary.sizes, model.vocabulary.kinds, model.network))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes, kinds, net = held.value
        shares, kind = np.log10(sizes + ADD * (kinds + 1)), np.min_scalar_type(len(sizes))
        for batch in pieces(batches, 5):
            n = batch.column(2).to_numpy()
            units = np.frombuffer(b"".join(batch.column(5).to_pylist()), kind).astype(np.int32)
            own = np.bincount(np.repeat(np.arange(len(n)), n), weights=net.log_probabilities(contexts(units, n), units) - shares[units], minlength=len(n))
            columns = [*(batch.column(i) for i in range(5)), pa.array(own, pa.float64()), batch.column(6), batch.column(7)]
            yield pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in _SCORED.split(", ")])

    rows = walked.where("piece IS NULL").select("doc_id", "held_out", "n_tokens", "n_known", "logs", "body", "words", "times")
    base = stored(rows.mapInArrow(scored, _SCORED).withColumn("row", F.monotonically_increasing_id()), "scored")
    rare = base.select("row", F.explode(F.arrays_zip("words", "times")).alias("x")).select("row", F.col("x.words").alias("word"), F.col("x.times").alias("n"))
    counts = model.counts.where(F.col("c") < model.least).select(F.col("word").alias("_word"), "c")
    c = F.coalesce("c", F.lit(0))
    joined = rare.join(counts, F.col("word") == F.col("_word"), "left")
    sums = joined.groupBy(F.col("row").alias("_row")).agg(F.sum(F.col("n") * F.log10(c + F.lit(ADD))).alias("more"), F.sum(F.when(c > 0, F.col("n")).otherwise(0)).alias("known"))
    out = base.drop("words", "times").join(sums, F.col("row") == F.col("_row"), "left")
    logs = F.col("logs") + F.coalesce("more", F.lit(0.0))
    each = float(np.log10(model.tokens + ADD * (model.kinds + 1)))
    return out.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.coalesce("known", F.lit(0))).cast("long").alias("n_known"),
        F.lit(model.tokens).cast("long").alias("train_tokens"),
        (logs - F.col("n_tokens") * F.lit(each)).alias("base_score"),
        (logs + F.col("model")).alias("score"),
    )


def score_documents(docs: DataFrame, folds: int = 10) -> DataFrame:
    """log10 probabilities of every whole text under a unigram base and under the log-bilinear model.

    ``docs`` has doc_id and text; other columns are ignored. The models learn from the rows whose crc32(doc_id as text) mod
    ``folds`` is not 0. Null and empty texts are a single end. A null doc_id is held out. Repeated rows count again.
    Without training texts every word is unseen. An empty table gives an empty table.
    """
    held = F.coalesce(fold(F.col("doc_id"), folds) == 0, F.lit(True))
    model = fit(docs.select("doc_id", held.alias("held_out"), F.coalesce("text", F.lit("")).cast("binary").alias("text")))
    return _scores(model.walked, model)
