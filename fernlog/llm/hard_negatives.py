"""Hard negatives by inner product: a vector-approximation file scanned for score bounds, exact scores of what may still count.

Every vector is approximated by the cells that its components fall in (four bits a dimension). For an anchor, a table by
dimension and cell holds the least and the largest product that the cell allows, so that sums of looked-up values bound a score. All values are
integers, and so are the bounds: nothing is lost to rounding.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fernlog.llm.common import discard, stored

#: Cells of a dimension; rows that they are fitted on.
CELLS, SAMPLE = 16, 20_000
#: Anchors that are sent to the executors at once, and that are looked up together; rows of a block; exact scores at once.
SLICE, GROUP, ROWS, EXACT = 1_024, 256, 4_096, 65_536
#: Larger integers might leave the range of a score.
LARGEST = 1 << 28
_CODED = "vec_id bigint, uid bigint, label bigint, values binary, cells binary"
_FOUND = "anchor int, slot int, vec_id bigint, uid bigint, score bigint"


def usable(vectors: DataFrame, scale: int) -> DataFrame:
    """uid, vec_id, label and the integer components of the rows that take part."""
    e = F.col("embedding").cast("array<double>")
    fine = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    whole = F.transform(e, lambda x: F.floor(x * scale).cast("long"))
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), whole.alias("values")).where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & fine)


def _matrix(lists: pa.Array, dim: int) -> np.ndarray:
    """Vectors as rows of 64-bit integers; shorter ones end in zeros."""
    flat, sizes = lists.flatten().to_numpy(zero_copy_only=False), np.diff(lists.offsets.to_numpy())
    out = np.zeros((len(sizes), dim), np.int64)
    out[np.arange(dim) < sizes[:, None]] = flat
    if np.abs(out).max(initial=0) > LARGEST:
        raise ValueError(f"components beyond {LARGEST} after scaling don't fit an integer score")
    return out


class Cells:
    """Borders of the cells: cell c of a dimension holds the integers from ``low[d, c]`` to ``high[d, c]``."""

    def __init__(self, sample: np.ndarray, least: np.ndarray, most: np.ndarray) -> None:
        """Halfway between equally filled and equally wide on the sample, as long tails make outer cells of the first kind wide and crowd inner
        ones of the second; the outer cells reach to the least and the largest component of all rows."""
        share = np.linspace(0, 1, CELLS + 1)[1:-1]
        filled, wide = np.quantile(sample, share, axis=0), np.min(sample, axis=0) + np.outer(share, np.ptp(sample, axis=0))
        self.inner = inner = np.floor((filled + wide).T / 2).astype(np.int64)
        self.low = np.concatenate([least[:, None], inner + 1], axis=1)
        self.high = np.concatenate([inner, most[:, None]], axis=1)
        # a cell that no row can fall in bounds nothing wrongly
        self.high = np.maximum(self.low, self.high)

    def of(self, x: np.ndarray) -> np.ndarray:
        """Two cells in a byte."""
        cells = np.stack([np.searchsorted(b, x[:, d]) for d, b in enumerate(self.inner)], axis=1).astype(np.uint8)
        if cells.shape[1] % 2:
            cells = np.concatenate([cells, np.zeros((len(cells), 1), np.uint8)], axis=1)
        return cells[:, ::2] << 4 | cells[:, 1::2]

    def tables(self, anchors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and largest product for each byte of the cells, each of its values and each anchor: (bytes, 256, anchors)."""
        ends = anchors.T[:, None, :] * self.low[:, :, None], anchors.T[:, None, :] * self.high[:, :, None]
        out = []
        for t in (np.minimum(*ends), np.maximum(*ends)):
            if len(t) % 2:
                t = np.concatenate([t, np.zeros((1, *t.shape[1:]), np.int64)])
            both = (t[::2, :, None] + t[1::2, None]).reshape(len(t) // 2, CELLS * CELLS, -1)
            # half the memory where every sum of them fits
            out.append(both.astype(np.int32) if np.abs(both).max(axis=(1, 2)).sum() < 1 << 31 else both)
        return out[0], out[1]


def _bound(table: np.ndarray, cells: np.ndarray) -> np.ndarray:
    """Sums of looked-up values: (anchors, rows)."""
    out = np.zeros((len(cells), table.shape[2]), table.dtype)
    for b in range(len(table)):
        out += table[b][cells[:, b]]
    return out.T


class First:
    """For each slot the ``k`` rows of highest score so far, smaller ids first among equals."""

    def __init__(self, slots: int, k: int) -> None:
        self.k, self.kept = k, np.zeros(0, [("slot", "i8"), ("score", "i8"), ("vec_id", "i8"), ("uid", "i8")])
        #: The score of each slot's last row, once it has ``k``; one as high may still win by its id.
        self.least = np.full(slots, np.iinfo(np.int64).min)

    def add(self, slot: np.ndarray, score: np.ndarray, vec_id: np.ndarray, uid: np.ndarray) -> None:
        new = np.zeros(len(slot), self.kept.dtype)
        new["slot"], new["score"], new["vec_id"], new["uid"] = slot, score, vec_id, uid
        both = np.concatenate([self.kept, new])
        both = both[np.lexsort((both["uid"], both["vec_id"], -both["score"], both["slot"]))]
        begins = np.flatnonzero(np.diff(both["slot"], prepend=-1))
        place = np.arange(len(both)) - np.repeat(begins, np.diff(begins, append=len(both)))
        self.kept = both[place < self.k]
        full = both[place == self.k - 1]
        self.least[full["slot"]] = full["score"]


def _blocks(batches: Iterator[pa.RecordBatch], dim: int) -> Iterator[tuple]:
    """Blocks of at most ROWS rows: ids, uids, labels, integers, cells."""
    for batch in batches:
        for lo in range(0, batch.num_rows, ROWS):
            b = batch.slice(lo, ROWS)
            raw = lambda i, kind, b=b: np.frombuffer(b"".join(b.column(i).to_pylist()), kind).reshape(b.num_rows, -1)
            yield *(b.column(i).to_numpy() for i in range(3)), raw(3, np.int64).reshape(b.num_rows, dim), raw(4, np.uint8)


def _exact(anchors: np.ndarray, rows: np.ndarray, a: np.ndarray, r: np.ndarray) -> np.ndarray:
    """Scores of pairs of an anchor and a row, some at a time."""
    return np.concatenate([np.zeros(0, np.int64), *(np.einsum("pd,pd->p", anchors[a[i : i + EXACT]], rows[r[i : i + EXACT]]) for i in range(0, len(a), EXACT))])


def _out(found: First, width: int) -> Iterator[pa.RecordBatch]:
    k = found.kept
    if len(k):
        yield pa.RecordBatch.from_arrays([pa.array(k["slot"] // width, pa.int32()), pa.array(k["slot"] % width, pa.int32()), pa.array(k["vec_id"]), pa.array(k["uid"]), pa.array(k["score"])], [x.split()[0] for x in _FOUND.split(", ")])


def _positives(blocks, cells: Cells, anchors: dict, k: int) -> Iterator[pa.RecordBatch]:
    """A task's best other rows of each anchor's label. Of them only those are scored whose upper bound reaches the ``k``-th best
    lower bound of the block, or the ``k``-th best score so far."""
    n = len(anchors["uid"])
    found, tables = First(n, k), {}
    by = [np.flatnonzero(anchors["label"] == x) for x in np.unique(anchors["label"])]
    for ids, uids, labels, values, coded in blocks:
        for mine in by:
            rows = np.flatnonzero(labels == anchors["label"][mine[0]])
            for lo in range(0, len(mine) if len(rows) else 0, GROUP):
                a = mine[lo : lo + GROUP]
                if a[0] not in tables:
                    tables[a[0]] = cells.tables(anchors["values"][a])
                least, most = (_bound(t, coded[rows]) for t in tables[a[0]])
                other = anchors["uid"][a][:, None] != uids[rows]
                need = found.least[a]
                if len(rows) > k:  # one more than k, as the anchor itself may be among them
                    need = np.maximum(need, np.partition(least, len(rows) - k - 1, axis=1)[:, len(rows) - k - 1])
                x, y = np.nonzero(other & (most >= need[:, None]))
                score = _exact(anchors["values"], values, a[x], rows[y])
                keep = score >= found.least[a[x]]
                found.add(a[x][keep], score[keep], ids[rows[y]][keep], uids[rows[y]][keep])
    yield from _out(found, 1)


def _negatives(blocks, cells: Cells, anchors: dict, windows: np.ndarray, k: int) -> Iterator[pa.RecordBatch]:
    """A task's first rows of other labels in each window of scores: ``windows`` is (anchors, windows, 2), both ends inclusive and
    empty where the first end is above the second. Scored are rows whose bounds overlap a window and whose upper bound reaches what
    the window's last kept row has."""
    n, width = windows.shape[:2]
    found = First(n * width, k)
    groups = [np.arange(lo, min(lo + GROUP, n)) for lo in range(0, n, GROUP)]
    tables = [cells.tables(anchors["values"][a]) for a in groups]
    for ids, uids, labels, values, coded in blocks:
        for a, t in zip(groups, tables, strict=True):
            least, most = (_bound(x, coded) for x in t)
            other = anchors["label"][a][:, None] != labels
            may = np.zeros(other.shape, bool)
            for w in range(width):
                lo, hi = windows[a, w].T
                reach = np.maximum(lo, found.least[a * width + w])
                # rows that lie in the window for certain raise what the others must reach
                sure = np.where(other & (least >= lo[:, None]) & (most <= hi[:, None]), least, np.iinfo(least.dtype).min)
                if sure.shape[1] >= k:
                    reach = np.maximum(reach, np.partition(sure, sure.shape[1] - k, axis=1)[:, sure.shape[1] - k])
                may |= (most >= reach[:, None]) & (least <= hi[:, None]) & (lo <= hi)[:, None]
            x, y = np.nonzero(may & other)
            score = _exact(anchors["values"], values, a[x], y)
            for w in range(width):
                lo, hi = windows[a[x], w].T
                keep = (score >= lo) & (score <= hi) & (score >= found.least[a[x] * width + w])
                found.add(a[x][keep] * width + w, score[keep], ids[y][keep], uids[y][keep])
    yield from _out(found, width)


def _best(spark: SparkSession, coded: DataFrame, run, k: int) -> DataFrame:
    """The tasks' rows of ``run`` over the stored vectors, and of all of them the first ``k`` of each slot."""
    place = F.row_number().over(Window.partitionBy("anchor", "slot").orderBy(F.desc("score"), "vec_id", "uid"))
    return coded.select("vec_id", "uid", "label", "values", "cells").mapInArrow(run, _FOUND).withColumn("rank", place).where(F.col("rank") <= k)


def mine(vectors: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100, scale: int = 256) -> DataFrame:
    """For each anchor and each of its positives the hardest negatives that aren't harder than allowed: anchor_id, positive_id, rank,
    negative_id, positive_score, negative_score.

    ``vectors`` has vec_id, label and embedding; ``is_anchor`` chooses the anchors by vec_id. A component x counts as floor(scale * x), a score
    is the integer inner product, and higher scores come first, then smaller ids. An anchor's positives are its first ``positives`` other
    rows of its label; a positive's negatives are the first ``negatives`` rows of other labels whose score, times 100, lies between ``low`` and ``high``
    times the positive's.

    The cells are fitted on at most about SAMPLE rows, which only decides how narrow bounds are; every row is coded, once, and
    stored. Anchors go to the executors in slices of SLICE, whose results are stored one after the other; a slice scans the file twice, for
    positives and for negatives. A task keeps a few rows a window, whatever it reads, and exact scores are taken in parts of EXACT pairs.

    Rows with a null vec_id, a null label, a null vector, or null or non-finite components take no part. A vector that is shorter than
    the longest counts as if it ended in zeros. Rows with a repeated vec_id are rows, and anchors, of their own. No anchors, no
    positives or no negatives give no rows. A component of more than LARGEST after scaling is an error.
    """
    spark = vectors.sparkSession
    own = stored(usable(vectors, scale).withColumn("uid", F.monotonically_increasing_id()), "vectors")
    n, dim = own.agg(F.count("*"), F.coalesce(F.max(F.size("values")), F.lit(0))).first()
    anchors = own.where(is_anchor)
    slices = -(-anchors.count() // SLICE) if n else 0
    parts = []
    if slices:
        dim = max(1, dim)
        coded = _coded(own, n, dim)
        for turn in range(slices):
            some = anchors.where(F.pmod(F.xxhash64("uid", F.lit("slice")), F.lit(slices)) == turn)
            parts.append(stored(_slice(spark, coded[0], coded[1], some, dim, positives, negatives, low, high), "mined"))
        discard(coded[0])
    discard(own)
    if not parts:
        return spark.createDataFrame([], "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint")
    return spark.read.schema(parts[0].schema).parquet(*[p._scratch for p in parts])


def _coded(own: DataFrame, n: int, dim: int) -> tuple[DataFrame, Cells]:
    """The stored file of integers and cells, and the cells."""
    spark = own.sparkSession

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least, most = np.full(dim, LARGEST + 1), np.full(dim, -LARGEST - 1)
        for b in batches:
            if b.num_rows:
                x = _matrix(b.column(0), dim)
                least, most = np.minimum(least, x.min(axis=0)), np.maximum(most, x.max(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(range(dim), pa.int32()), pa.array(least), pa.array(most)], ["d", "least", "most"])

    found = own.select("values").mapInArrow(ends, "d int, least bigint, most bigint").groupBy("d").agg(F.min("least"), F.max("most")).orderBy("d").collect()
    part = F.pmod(F.xxhash64("uid"), F.lit(1_000_000)) < int(min(1.0, SAMPLE / n) * 1_000_000)
    sample = own.where(part).select("values").toArrow()["values"].combine_chunks()
    if not len(sample):
        sample = own.select("values").limit(SAMPLE).toArrow()["values"].combine_chunks()
    cells = Cells(_matrix(sample, dim), np.array([r[1] for r in found]), np.array([r[2] for r in found]))
    held = spark.sparkContext.broadcast(cells)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, ROWS):
                b = batch.slice(lo, ROWS)
                x = _matrix(b.column(3), dim)
                data = [pa.array([v.tobytes() for v in m], pa.binary()) for m in (x, held.value.of(x))]
                yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(3)), *data], ["vec_id", "uid", "label", "values", "cells"])

    return stored(own.select("vec_id", "uid", "label", "values").mapInArrow(encode, _CODED), "coded"), cells


def _slice(spark: SparkSession, coded: DataFrame, cells: Cells, some: DataFrame, dim: int, positives: int, negatives: int, low: int, high: int) -> DataFrame:
    """``mine`` for at most about SLICE anchors, which are held on the driver with their positives."""
    rows = some.select("vec_id", "uid", "label", "values").toArrow().combine_chunks()
    ids = rows["vec_id"].to_numpy()
    anchors = {"uid": rows["uid"].to_numpy(), "label": rows["label"].to_numpy(), "values": _matrix(rows["values"].combine_chunks(), dim) if len(rows) else np.zeros((0, dim), np.int64)}
    held = spark.sparkContext.broadcast((cells, anchors))

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _positives(_blocks(batches, dim), *held.value, positives)

    own = _best(spark, coded, near, positives).select("anchor", (F.col("rank") - 1).alias("slot"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")).collect()
    windows = np.zeros((len(ids), positives, 2), np.int64)
    windows[:, :, 0] = 1
    for r in own:
        windows[r.anchor, r.slot] = -(-low * r.positive_score // 100), high * r.positive_score // 100
    sent = spark.sparkContext.broadcast(windows)

    def far(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _negatives(_blocks(batches, dim), *held.value, sent.value, negatives)

    found = _best(spark, coded, far, negatives).select("anchor", "slot", "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    pairs = spark.createDataFrame([(r.anchor, r.slot, int(ids[r.anchor]), r.positive_id, r.positive_score) for r in own], "anchor int, slot int, anchor_id bigint, positive_id bigint, positive_score bigint")
    return found.join(F.broadcast(pairs), ["anchor", "slot"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


#: Scores of all pairs of an anchor and a row, ranked.
ORACLE = """
WITH v AS (SELECT row_number() OVER () AS uid, vec_id, (CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END)::BIGINT AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS (SELECT a.uid AS a_uid, a.vec_id AS anchor_id, b.uid AS b_uid, b.vec_id AS other_id, a.label = b.label AS same, list_dot_product(a.e, b.e)::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.uid <> b.uid),
p AS (SELECT a_uid, anchor_id, b_uid, other_id AS positive_id, score AS positive_score FROM pairs WHERE same
  QUALIFY row_number() OVER (PARTITION BY a_uid ORDER BY score DESC, other_id, b_uid) <= 5)
SELECT anchor_id, positive_id, (row_number() OVER (PARTITION BY p.a_uid, p.b_uid ORDER BY n.score DESC, n.other_id, n.b_uid))::INT AS rank,
  n.other_id AS negative_id, positive_score, n.score AS negative_score
FROM p JOIN (SELECT a_uid, b_uid, other_id, score FROM pairs WHERE NOT same) n USING (a_uid)
WHERE 80 * positive_score <= 100 * n.score AND 100 * n.score <= 100 * positive_score
QUALIFY rank <= 5"""
