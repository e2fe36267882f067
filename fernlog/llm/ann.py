"""Approximate nearest neighbours by inner product: score-aware quantisation, four-bit table scans, exact reranking."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fernlog.llm.common import stored

#: Queries that are sent to the executors at once; more are taken in turns of this size.
SLICE = 4_096
#: Rows that the codebooks are fitted on; values of a subspace; codes of it.
SAMPLE, SUB, CODES = 20_000, 2, 16
_QUERIES, _ROWS = 256, 8_192
_ROW = "struct<vec_id bigint, uid bigint>"
_CODED = f"embedding array<double>, ids array<{_ROW}>, codes binary"
_FOUND = f"query_id bigint, query_uid bigint, ids array<{_ROW}>, score double"


@dataclass
class Quantiser:
    """Codebooks (subspaces, 16, values) for the loss |r|^2 + (eta - 1) (r . x/|x|)^2 of the residual r.

    Errors along the vector change large inner products most, so that they weigh eta times as much as errors across it.
    """

    books: np.ndarray
    dim: int
    eta: float

    def split(self, x: np.ndarray) -> np.ndarray:
        m = len(self.books)
        out = np.zeros((len(x), m * SUB))
        out[:, : self.dim] = x
        return out.reshape(len(x), m, SUB)

    def encode(self, x: np.ndarray, sweeps: int = 3) -> np.ndarray:
        """Codes by coordinate descent: each subspace in turn takes the code of least loss given the others."""
        parts = self.split(x)
        unit = parts / np.maximum(np.sqrt((parts**2).sum(axis=(1, 2), keepdims=True)), 1e-30)
        codes = np.stack([((parts[:, m, None] - b[None]) ** 2).sum(axis=2).argmin(axis=1) for m, b in enumerate(self.books)], axis=1)
        along = self._along(parts, unit, codes)
        for _ in range(sweeps):
            for m, b in enumerate(self.books):
                r = parts[:, m, None] - b[None]
                a = np.einsum("nks,ns->nk", r, unit[:, m])
                rest = along.sum(axis=1) - along[:, m]
                codes[:, m] = ((r**2).sum(axis=2) + (self.eta - 1) * (rest[:, None] + a) ** 2).argmin(axis=1)
                along[:, m] = a[np.arange(len(x)), codes[:, m]]
        return codes.astype(np.uint8)

    def _along(self, parts: np.ndarray, unit: np.ndarray, codes: np.ndarray) -> np.ndarray:
        r = parts - np.stack([b[codes[:, m]] for m, b in enumerate(self.books)], axis=1)
        return (r * unit).sum(axis=2)

    @classmethod
    def fit(cls, x: np.ndarray, threshold: float = 0.2, rounds: int = 6, seed: int = 7) -> Quantiser:
        """Codebooks from a sample: k-means for each subspace, then alternating codes and least squares for the loss."""
        dim = x.shape[1]
        eta = max(1.0, (dim - 1) * threshold**2 / (1 - threshold**2))
        own = cls(np.zeros((-(-dim // SUB), CODES, SUB)), dim, eta)
        parts, rng = own.split(x), np.random.default_rng(seed)
        for m in range(len(own.books)):
            b = parts[rng.choice(len(x), CODES), m] + rng.normal(0, 1e-6, (CODES, SUB))
            for _ in range(10):
                near = ((parts[:, m, None] - b[None]) ** 2).sum(axis=2).argmin(axis=1)
                n = np.bincount(near, minlength=CODES)
                mean = np.stack([np.bincount(near, weights=parts[:, m, s], minlength=CODES) for s in range(SUB)], axis=1)
                b = np.where(n[:, None] > 0, mean / np.maximum(n, 1)[:, None], b)
            own.books[m] = b
        unit = parts / np.maximum(np.sqrt((parts**2).sum(axis=(1, 2), keepdims=True)), 1e-30)
        for _ in range(rounds):
            codes = own.encode(x)
            along = own._along(parts, unit, codes)
            for m in range(len(own.books)):
                u = unit[:, m]
                target = along.sum(axis=1) - along[:, m] + (parts[:, m] * u).sum(axis=1)
                left = np.eye(SUB)[None] + (eta - 1) * u[:, :, None] * u[:, None, :]
                right = parts[:, m] + (eta - 1) * u * target[:, None]
                for k in np.unique(codes[:, m]):
                    rows = codes[:, m] == k
                    own.books[m, k] = np.linalg.solve(left[rows].sum(axis=0), right[rows].sum(axis=0))
                along[:, m] = ((parts[:, m] - own.books[m][codes[:, m]]) * u).sum(axis=1)
        return own


def _packed_codes(codes: np.ndarray) -> np.ndarray:
    """Two four-bit codes in a byte."""
    if codes.shape[1] % 2:
        codes = np.concatenate([codes, np.zeros((len(codes), 1), np.uint8)], axis=1)
    return codes[:, ::2] << 4 | codes[:, 1::2]


def tables(quantiser: Quantiser, queries: np.ndarray) -> np.ndarray:
    """For each byte of a code and each of its 256 values the part of the inner product: (bytes, 256, queries)."""
    t = np.einsum("qms,mks->mkq", quantiser.split(queries), quantiser.books)
    if len(t) % 2:
        t = np.concatenate([t, np.zeros((1, *t.shape[1:]))])
    return (t[::2, :, None] + t[1::2, None]).reshape(len(t) // 2, CODES * CODES, -1).astype(np.float32)


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and embedding (doubles) of the rows that take part."""
    e = F.col("embedding").cast("array<double>")
    fine = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), e.alias("embedding")).where(F.col("vec_id").isNotNull() & fine & F.exists("embedding", lambda x: x != 0))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Vectors as rows; shorter ones end in zeros."""
    flat, sizes = column.flatten().to_numpy(zero_copy_only=False), np.diff(column.offsets.to_numpy())
    if (sizes == dim).all():
        return flat.reshape(-1, dim)
    out = np.zeros((len(sizes), dim))
    out[np.arange(dim) < sizes[:, None]] = flat
    return out


def _blocks(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of exactly ``rows`` but for the last one, however they come."""
    held: list[pa.RecordBatch] = []
    n = 0
    for batch in batches:
        while batch.num_rows:
            held.append(batch.slice(0, rows - n))
            n, batch = n + held[-1].num_rows, batch.slice(rows - n)
            if n == rows:
                yield pa.concat_batches(held)
                held, n = [], 0
    if held:
        yield pa.concat_batches(held)


def search(vectors: DataFrame, is_query: Column, k: int = 20, depth: int = 200) -> DataFrame:
    """The ``k`` vectors of largest inner product with each query: query_id, rank, vec_id, score.

    ``vectors`` has vec_id and embedding; ``is_query`` chooses the queries by vec_id. Every row but the query's own is a
    candidate. Equal vectors are scanned once and stand for their smallest ids. All rows are coded once and the codes are
    stored beside the vectors; the codebooks are fitted on at most about SAMPLE rows. Queries go to the executors in slices
    of SLICE. A task scans the codes of its rows in blocks of _ROWS with tables for the queries, ranks the ``depth`` best of a
    block for each query by the exact product in double precision, and hands on the best of all its blocks. So neither results
    nor cost depend on how rows are batched.

    Rows with a null vec_id, or whose vector is null, zero, or has null or non-finite components, take no part. A vector
    that is shorter than the longest counts as if it ended in zeros. Rows with a repeated vec_id are candidates, and queries, of
    their own. Ties go to the smaller vec_id. Fewer candidates than ``k`` give fewer rows; no query or candidate gives none.
    """
    spark = vectors.sparkSession
    own = stored(usable(vectors).withColumn("uid", F.monotonically_increasing_id()), "vectors")
    dim = own.agg(F.coalesce(F.max(F.size("embedding")), F.lit(1))).first()[0]
    place = F.row_number().over(Window.partitionBy("embedding").orderBy("vec_id", "uid"))
    near = own.withColumn("at", place).where(F.col("at") <= k + 1)
    distinct = stored(near.groupBy("embedding").agg(F.sort_array(F.collect_list(F.struct("vec_id", "uid"))).alias("ids")), "distinct")
    n = distinct.count()
    queries = own.where(is_query)
    slices = -(-queries.count() // SLICE) if n else 0
    if not slices:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    part = F.pmod(F.xxhash64("embedding"), F.lit(1_000_000)) < int(min(1.0, SAMPLE / n) * 1_000_000)
    sample = distinct.where(part).select("embedding").toArrow()["embedding"].combine_chunks()
    if not len(sample):
        sample = distinct.select("embedding").limit(SAMPLE).toArrow()["embedding"].combine_chunks()
    quantiser = Quantiser.fit(_matrix(sample, dim))
    held_books = spark.sparkContext.broadcast(quantiser)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _blocks(batches, _ROWS):
            codes = _packed_codes(held_books.value.encode(_matrix(batch.column(0), dim)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([c.tobytes() for c in codes], pa.binary())], ["embedding", "ids", "codes"])

    coded = stored(distinct.select("embedding", "ids").mapInArrow(encode, _CODED), "coded")

    def scan(held):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names, q, quantiser = held.value
            best = _Best(len(q), k + 1)
            looked = [tables(quantiser, q[i : i + _QUERIES]) for i in range(0, len(q), _QUERIES)]
            for part in _blocks(batches, _ROWS):
                x = _matrix(part.column(0), dim)
                codes = np.frombuffer(b"".join(part.column(2).to_pylist()), np.uint8).reshape(len(x), -1)
                for i, t in enumerate(looked):
                    approximate = np.zeros((len(x), t.shape[2]), np.float32)
                    for b in range(len(t)):
                        approximate += t[b][codes[:, b]]
                    s = approximate.T
                    top = np.argpartition(-s, depth - 1, axis=1)[:, :depth] if len(x) > depth else np.broadcast_to(np.arange(len(x)), (len(s), len(x)))
                    rows = q[i * _QUERIES : i * _QUERIES + len(s)]
                    exact = np.einsum("qd,qcd->qc", rows, x[top])
                    best.add(i * _QUERIES, top, exact, part.column(1))
            yield from best.out(names)

        return run

    found = None
    for turn in range(slices):
        mine = queries.where(F.pmod(F.xxhash64("uid", F.lit("slice")), F.lit(slices)) == turn).toArrow().combine_chunks()
        names = np.stack([mine["vec_id"].to_numpy(), mine["uid"].to_numpy()], axis=1)
        q = _matrix(mine["embedding"].combine_chunks(), dim) if len(mine) else np.zeros((0, dim))
        held = spark.sparkContext.broadcast((names, q, quantiser))
        some = coded.mapInArrow(scan(held), _FOUND)
        found = some if found is None else found.unionByName(some)
    rows = found.select("query_id", "query_uid", F.explode("ids").alias("c"), "score").where("c.uid != query_uid")
    rank = F.row_number().over(Window.partitionBy("query_uid").orderBy(F.desc("score"), "c.vec_id", "c.uid"))
    return rows.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", F.col("c.vec_id").alias("vec_id"), "score")


class _Best:
    """The best candidates of each query so far, by exact score and smallest id."""

    def __init__(self, queries: int, k: int) -> None:
        self.k = k
        self.score = np.full((queries, k), -np.inf)
        self.first = np.full((queries, k), np.iinfo(np.int64).max)
        self.at = np.full((queries, k), -1)
        self.ids: list = []

    def add(self, lo: int, rows: np.ndarray, exact: np.ndarray, ids: pa.Array) -> None:
        n = len(rows)
        firsts = ids.flatten().field("vec_id").to_numpy()[ids.offsets.to_numpy()[:-1] - ids.offsets[0].as_py()]
        own = slice(lo, lo + n)
        score = np.concatenate([self.score[own], exact], axis=1)
        first = np.concatenate([self.first[own], firsts[rows]], axis=1)
        at = np.concatenate([self.at[own], np.where(rows >= 0, -2 - rows, 0)], axis=1)
        order = np.lexsort((first, -score), axis=1)[:, : self.k]
        self.score[own], self.first[own] = np.take_along_axis(score, order, 1), np.take_along_axis(first, order, 1)
        at = np.take_along_axis(at, order, 1)
        new = at <= -2
        used, place = np.unique(-2 - at[new], return_inverse=True)
        base = len(self.ids)
        self.ids += ids.take(pa.array(used)).to_pylist()
        at[new] = base + place
        self.at[own] = at

    def out(self, names: np.ndarray) -> Iterator[pa.RecordBatch]:
        row = pa.list_(pa.struct([("vec_id", pa.int64()), ("uid", pa.int64())]))
        for lo in range(0, len(names), 1_024):
            q, c = np.nonzero(self.at[lo : lo + 1_024] >= 0)
            lists = pa.array([self.ids[i] for i in self.at[lo + q, c]], row)
            yield pa.RecordBatch.from_arrays([pa.array(names[lo + q, 0]), pa.array(names[lo + q, 1]), lists, pa.array(self.score[lo + q, c], pa.float64())], ["query_id", "query_uid", "ids", "score"])
