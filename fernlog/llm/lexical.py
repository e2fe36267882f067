"""Ranked lexical search: an inverted index of compressed posting blocks with maximum impacts, read by Block-Max WAND.

An index is a table. A *segment* is a run of documents of one task, at most SEGMENT of them; in it documents are numbered from 0.
A row is either a segment's own (``term`` null: ids and lengths of its documents) or one block of at most BLOCK postings of a
term. A block names its first and last document, and its competitive pairs (tf, length): the postings that no other of the block beats
with as many occurrences in as short a text. Whatever the statistics of the corpus turn out to be, its maximum impact is that of
one of these pairs, so that an index is made in one pass and segments may be added later.
"""

from __future__ import annotations

import math
from array import array
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from fernlog.llm.common import discard, pieces, stored

#: Postings of a block; documents and postings that close a segment.
BLOCK, SEGMENT, POSTINGS = 128, 16_384, 2_000_000
#: Blocks of a list that is short.
SHORT = 8
#: Distinct terms, and (item, term) pairs, that are sent to the executors at once.
MOST_TERMS, MOST_PAIRS = 1_000_000, 500_000
#: Bytes of a text that are cut into terms at once.
CUT = 1 << 20
_INDEX = "segment bigint, term binary, block int, docs bigint, tokens bigint, first int, last int, n int, best_tf array<int>, best_length array<bigint>, gaps binary, tfs binary, ids array<bigint>, lengths array<bigint>"
_KINDS = [("segment", pa.int64()), ("term", pa.binary()), ("block", pa.int32()), ("docs", pa.int64()), ("tokens", pa.int64()), ("first", pa.int32()), ("last", pa.int32()), ("n", pa.int32()), ("best_tf", pa.list_(pa.int32())),
  ("best_length", pa.list_(pa.int64())), ("gaps", pa.binary()), ("tfs", pa.binary()), ("ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64()))]
_HEAD = ["first", "last", "n", "best_tf", "best_length", "gaps", "tfs"]
_FOUND = "item int, doc_id bigint, score bigint"
_TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: What is no part of a term becomes a space, A-Z become a-z, all bytes from 0x80 on stay.
_FOLD = bytes(c if c >= 0x80 else (c + 32 if 65 <= c <= 90 else c if chr(c).isalnum() else 32) for c in range(256))


def terms_of(text: bytes) -> Iterator[list[bytes]]:
    """Terms of a UTF-8 text in lists, each from about CUT bytes of it."""
    text = text.translate(_FOLD)
    lo = 0
    while lo < len(text):
        hi = text.find(b" ", lo + CUT) if lo + CUT < len(text) else -1
        hi = len(text) if hi < 0 else hi
        yield text[lo:hi].split()
        lo = hi


def _pack(values: np.ndarray) -> bytes:
    """Non-negative integers at the width of the largest: a byte with the width, then the bits."""
    width = int(values.max()).bit_length() if len(values) else 0
    bits = (values[:, None] >> np.arange(width)) & 1
    return bytes([width]) + np.packbits(bits.astype(np.uint8).ravel()).tobytes()


def _unpack(data: bytes, n: int) -> np.ndarray:
    width = data[0]
    if not width:
        return np.zeros(n, np.int64)
    bits = np.unpackbits(np.frombuffer(data, np.uint8, offset=1), count=n * width).reshape(n, width)
    return bits @ (np.int64(1) << np.arange(width))


class _Segment:
    """Documents of a segment while it is made."""

    def __init__(self, name: int) -> None:
        self.name, self.ids, self.lengths = name, [], []
        self.terms: list[bytes] = []
        self.tfs, self.sizes = array("q"), array("q")

    def add(self, doc_id: int | None, counts: Counter, length: int, wanted: frozenset | None) -> None:
        found = list(counts) if wanted is None else list(counts.keys() & wanted)
        self.ids.append(doc_id)
        self.lengths.append(length)
        self.terms += found
        self.tfs.extend(map(counts.__getitem__, found))
        self.sizes.append(len(found))

    def rows(self) -> Iterator[pa.RecordBatch]:
        batch = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows, strict=True), _KINDS, strict=True)], [n for n, _ in _KINDS])
        lengths = np.array(self.lengths, np.int64)
        held = [(self.name, None, 0, int((lengths > 0).sum()), int(lengths.sum()), *[None] * 7, self.ids, self.lengths)]
        numbers = {t: i for i, t in enumerate(dict.fromkeys(self.terms))}
        number = np.fromiter(map(numbers.__getitem__, self.terms), np.int64, len(self.terms))
        order = np.argsort(number, kind="stable")
        docs, tfs = np.repeat(np.arange(len(lengths)), np.array(self.sizes, np.int64))[order], np.array(self.tfs, np.int64)[order]
        ends = np.cumsum(np.bincount(number, minlength=len(numbers)))
        for term, i in numbers.items():
            lo = int(ends[i - 1]) if i else 0
            for k, start in enumerate(range(lo, int(ends[i]), BLOCK)):
                at, tf = (x[start : min(start + BLOCK, int(ends[i]))] for x in (docs, tfs))
                by = np.lexsort((-tf, lengths[at]))
                best = np.maximum.accumulate(tf[by])
                keep = by[np.flatnonzero(np.diff(best, prepend=0))]
                held.append((self.name, term, k, None, None, int(at[0]), int(at[-1]), len(at), tf[keep].tolist(), lengths[at[keep]].tolist(), _pack(np.diff(at, prepend=at[0] - 1) - 1), _pack(tf - 1), None, None))
                if len(held) >= 4096:
                    yield batch(held)
                    held = []
        if held:
            yield batch(held)


def build_index(docs: DataFrame, terms: Iterable[bytes] | None = None) -> DataFrame:
    """Index rows of ``docs`` (doc_id, text). With ``terms`` only these get postings; lengths count all terms of a text either way.

    Texts are cut where they are read and nothing is shuffled. A null text has no terms; a null doc_id, and ids that occur in
    several rows, are documents of their own. An empty table gives an empty index.
    """
    spark = docs.sparkSession
    held = spark.sparkContext.broadcast(None if terms is None else frozenset(terms))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, base, n = held.value, TaskContext.get().partitionId() << 32, 0
        own = _Segment(base)
        for batch in batches:
            for part in pieces([batch], 1):
                texts = pc.cast(part.column(1), pa.binary())
                for doc_id, text in zip(part.column(0).to_pylist(), texts.to_pylist(), strict=True):
                    counts: Counter = Counter()
                    length = 0
                    for some in terms_of(text or b""):
                        length += len(some)
                        counts.update(some)
                    own.add(doc_id, counts, length, wanted)
                    if len(own.ids) >= SEGMENT or len(own.tfs) >= POSTINGS:
                        yield from own.rows()
                        n += 1
                        own = _Segment(base + n)
        if own.ids:
            yield from own.rows()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, _INDEX)


class Postings:
    """The blocks of a term in a segment: their heads, and their postings once they are asked for."""

    def __init__(self, rows: list[tuple], weight: int, spread: np.ndarray, spread_of) -> None:
        self.first, self.last = (np.array([r[i] for r in rows], np.int64) for i in (0, 1))
        tf = np.concatenate([np.asarray(r[3], np.int64) for r in rows])
        at = np.cumsum([0, *(len(r[3]) for r in rows[:-1])])
        most = impact(tf, spread_of(np.concatenate([np.asarray(r[4], np.int64) for r in rows])))
        self.most = weight * np.maximum.reduceat(most, at)
        self.weight, self.spread, self.rows = weight, spread, rows
        self.read: list = [None] * len(rows)
        self.whole = [np.concatenate(x) for x in zip(*map(self.block, range(len(rows))), strict=True)] if len(rows) <= SHORT else None

    def heads(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First and last documents of the stretches that the list bounds, and the bounds: those of blocks, or a short list's postings."""
        return (self.first, self.last, self.most) if self.whole is None else (self.whole[0], self.whole[0], self.whole[1])

    def block(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents and weighted impacts of a block, decompressed the first time."""
        if self.read[k] is None:
            first, _, n, _, _, gaps, tfs = self.rows[k]
            at = np.cumsum(_unpack(gaps, n) + 1) + first - 1
            self.read[k] = at, self.weight * impact(_unpack(tfs, n) + 1, self.spread[at])
        return self.read[k]


def impact(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return 1_000_000_000 * tf // (1_000 * tf + 8 * m)


class Best:
    """The ``k`` best documents of an item so far: higher scores, then smaller ids, then null ids."""

    def __init__(self, k: int) -> None:
        self.k, self.scores, self.ids, self.none = k, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)

    @property
    def least(self) -> int:
        """The score that a document needs to be looked at; one as high may still win by its id."""
        return max(1, int(self.scores[-1])) if len(self.scores) == self.k else 1

    def add(self, scores: np.ndarray, ids: np.ndarray, none: np.ndarray) -> None:
        scores, ids, none = (np.concatenate(x) for x in ((self.scores, scores), (self.ids, ids), (self.none, none)))
        order = np.lexsort((ids, none, -scores))[: self.k]
        self.scores, self.ids, self.none = scores[order], ids[order], none[order]


def walk(lists: list[Postings], ids: np.ndarray, none: np.ndarray, best: Best) -> None:
    """Block-Max WAND over one segment: ``best`` takes up what beats it.

    Between two neighbouring borders of blocks every list stands in one block or in none, so that one bound holds there: the sum of the
    maximum impacts of the blocks that overlap. (Of a short list, whose few blocks cover everything, the postings themselves are the
    borders.) A sweep over the heads moves all lists' shallow pointers through all these stretches at once. Stretches whose bound lies
    below the threshold are skipped unread; the pivot is the one of highest bound that is left, and the deep move to it decompresses the
    blocks that overlap it. Pivots are taken in growing groups, as the threshold rises.
    """
    heads, base = [p.heads() for p in lists], np.zeros(len(ids), np.int64)
    for p in lists:
        if p.whole is not None:
            base[p.whole[0]] += p.whole[1]
    border = np.concatenate([x for first, last, _ in heads for x in (first, last + 1)])
    change = np.concatenate([x for _, _, most in heads for x in (most, -most)])
    order = np.argsort(border, kind="stable")
    border, bound = border[order], np.cumsum(change[order])
    final = np.flatnonzero(np.diff(border, append=border[-1] + 1))
    border, bound = border[final], bound[final]
    lo, hi, bound = border[:-1], border[1:], bound[:-1]
    left = np.flatnonzero(bound >= best.least)
    left = left[np.argsort(-bound[left], kind="stable")]
    take = 8 * best.k
    while len(left := left[: np.searchsorted(-bound[left], -best.least, side="right")]):
        n = max(1, int(np.searchsorted(np.cumsum((hi - lo)[left]), take)))
        mine, left, take = left[:n], left[n:], take * 8
        edge = np.zeros(len(ids) + 1, np.int64)
        edge[lo[mine]] += 1
        edge[hi[mine]] -= 1
        live, score = np.cumsum(edge[:-1]) > 0, base.copy()
        for p in lists:
            if p.whole is None:
                k = np.minimum(np.searchsorted(p.last, lo[mine]), len(p.last) - 1)
                for b in np.flatnonzero(np.bincount(k[(p.first[k] < hi[mine]) & (p.last[k] >= lo[mine])])):
                    at, scored = p.block(b)
                    score[at] += scored
        found = np.flatnonzero(live & (score >= best.least))
        best.add(score[found], ids[found], none[found])


def _searched(batches: Iterator[pa.RecordBatch], items: list[list[bytes]], weights: dict[bytes, int], docs: int, tokens: int, k: int) -> Iterator[pa.RecordBatch]:
    """The best of all segments of a task for each item; rows come by segment, its own row first, and by term and block."""
    best = [Best(k) for _ in items]
    using: dict[bytes, list[int]] = {}
    for i, terms in enumerate(items):
        for t in terms:
            using.setdefault(t, []).append(i)
    spread_of = lambda n: 10 + 90 * n * docs // tokens
    rows: dict[bytes, list[tuple]] = {}
    own: tuple | None = None

    def finish() -> None:
        if own is None or not rows:
            return
        ids, none, spread = own
        lists = {t: Postings(r, weights[t], spread, spread_of) for t, r in rows.items()}
        for i in sorted({i for t in lists for i in using[t]}):
            walk([lists[t] for t in items[i] if t in lists], ids, none, best[i])

    for batch in batches:
        terms, held = batch.column(batch.schema.get_field_index("term")).to_pylist(), list(zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in _HEAD), strict=True))
        for x, term in enumerate(terms):
            if term is None:
                finish()
                ids, lengths = (batch.column(batch.schema.get_field_index(c))[x].values for c in ("ids", "lengths"))
                own = pc.fill_null(ids, 0).to_numpy(), ids.is_null().to_numpy(zero_copy_only=False), spread_of(lengths.to_numpy())
                rows = {}
            elif term in using:
                rows.setdefault(term, []).append(held[x])
    finish()
    for i, b in enumerate(best):
        if len(b.ids):
            yield pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(i, pa.int32()), len(b.ids)), pa.array(b.ids, pa.int64(), mask=b.none), pa.array(b.scores, pa.int64())], ["item", "doc_id", "score"])


def item_terms(text: str | None) -> list[bytes]:
    """The terms of an item, once each."""
    return sorted({t for some in terms_of((text or "").encode()) for t in some})


def search(index: DataFrame, items: list[tuple[object, str | None]], k: int = 10) -> DataFrame:
    """The ``k`` best documents of a stored ``index`` for each of ``items`` (item_id, text): item_id, rank, doc_id, score.

    The caller bounds ``items`` (``rank_documents`` goes through a table of any size in slices). Of the index only the rows of the
    items' terms are read; they are shuffled by segment, and a task takes its segments in turn, so that the thresholds that one leaves
    hold for the next. Weights follow from the document frequencies, which are summed over all blocks of a term.
    Items without terms have no rows, and items with the same id are ranked each for itself. Ties go to the smaller doc_id, null last.
    """
    spark = index.sparkSession
    terms = [item_terms(text) for _, text in items]
    wanted = {t for some in terms for t in some}
    docs, tokens = index.where("term IS NULL").agg(F.coalesce(F.sum("docs"), F.lit(0)), F.coalesce(F.sum("tokens"), F.lit(0))).first()
    asked = spark.createDataFrame([Row(term=bytearray(t)) for t in wanted], "term binary")
    blocks = index.where("term IS NOT NULL").join(F.broadcast(asked), "term", "left_semi")
    weights = {bytes(r.term): math.floor(1_000 * math.log((2 * docs + 2) / (2 * r.df + 1))) for r in blocks.groupBy("term").agg(F.sum("n").alias("df")).toLocalIterator()}
    own = index.where("term IS NULL")
    rows = own.select(blocks.columns).unionByName(blocks).select("segment", "term", "block", "first", "last", "n", "best_tf", "best_length", "gaps", "tfs", "ids", "lengths")
    held = spark.sparkContext.broadcast((terms, weights))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, weights = held.value
        return _searched(batches, terms, weights, docs, tokens, k)

    found = rows.repartition("segment").sortWithinPartitions("segment", F.asc_nulls_first("term"), "block").mapInArrow(run, _FOUND)
    place = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    names = spark.createDataFrame([(i, None if x is None else int(x)) for i, (x, _) in enumerate(items)], "item int, item_id bigint")
    return found.withColumn("rank", place).where(F.col("rank") <= k).join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")


def _slices(items: DataFrame) -> Iterator[list[tuple]]:
    """Items in lists of at most MOST_PAIRS different (item, term) pairs, or of one item with more."""
    held, n = [], 0
    for r in items.toLocalIterator():
        size = len(item_terms(r.text))
        if held and n + size > MOST_PAIRS:
            yield held
            held, n = [], 0
        held.append((r.item_id, r.text))
        n += size
    if held:
        yield held


def rank_documents(docs: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """The ``k`` documents (doc_id, text) of highest score for each of ``items`` (item_id, text): item_id, rank, doc_id, score.

    The index holds the postings of the items' terms, or of all terms if there are more than MOST_TERMS of them; it is stored and
    searched for items in slices, whose results are stored before the next one begins. Null and empty texts have no terms. No items or no
    documents give no rows.
    """
    spark = docs.sparkSession
    split = F.explode(F.array_distinct(F.regexp_extract_all(F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(f"({_TERM})"))))
    distinct = items.select(split.alias("term")).distinct().select(F.col("term").cast("binary")).limit(MOST_TERMS + 1).toArrow()["term"].to_pylist()
    index = stored(build_index(docs, distinct if len(distinct) <= MOST_TERMS else None), "index")
    parts = [stored(search(index, some, k), "ranked") for some in _slices(items.select("item_id", "text"))]
    discard(index)
    if not parts:
        return spark.createDataFrame([], "item_id bigint, rank int, doc_id bigint, score bigint")
    return spark.read.schema(parts[0].schema).parquet(*[p._scratch for p in parts])


#: A document's score sums, over an item's terms, the weight times the saturated count in its length's measure.
ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t FROM documents),
lengths AS (SELECT r, doc_id, len(t)::BIGINT AS n FROM d WHERE len(t) > 0),
totals AS (SELECT count(*)::BIGINT AS big_n, sum(n)::BIGINT AS big_l FROM lengths),
tf AS (SELECT r, term, count(*)::BIGINT AS tf FROM (SELECT r, unnest(t) AS term FROM d) GROUP BY ALL),
df AS (SELECT term, count(*)::BIGINT AS df FROM tf GROUP BY term),
i AS (SELECT row_number() OVER () AS q, item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t FROM benchmark),
asked AS (SELECT DISTINCT q, item_id, unnest(t) AS term FROM i),
scored AS (SELECT q, item_id, r, doc_id, sum(floor(1000 * ln((2 * big_n + 2)::DOUBLE / (2 * df + 1)))::BIGINT * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * big_n) // big_l))))::BIGINT AS score
  FROM asked JOIN df USING (term) JOIN tf USING (term) JOIN lengths USING (r), totals GROUP BY q, item_id, r, doc_id),
ranked AS (SELECT item_id, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id NULLS LAST)::INT AS rank, doc_id, score FROM scored WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 10"""
