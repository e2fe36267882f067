"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fernlog.storage import discard, keep_only, made, remove, scratch, stored

__all__ = ["ASCII_LOWER", "WORD", "ascii_lower", "connected_components", "discard", "fold", "in_pieces", "keep_only", "made", "packed", "pieces", "remove", "scratch", "small_batches", "stored", "words"]

#: A word: a run of anything but space, tab, line feed, vertical tab, form feed, carriage return.
WORD = r"[^\x20\x09-\x0D]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: For str.translate in tasks: lower-cases A-Z only.
ASCII_LOWER = dict(zip(map(ord, _UPPER), _LOWER, strict=True))
#: Edges that a task joins at a time (4 MB of them).
TASK_EDGES = 1 << 18


def ascii_lower(col: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(col, _UPPER, _LOWER)


def words(col: Column) -> Column:
    """The words of a text; no word for a null, empty or blank text."""
    return F.filter(F.split(F.coalesce(col, F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")


def fold(id_col: Column, n: int) -> Column:
    """crc32 of the id as text, mod n. A null id counts as an empty text (fold 0)."""
    return (F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % n).cast("int")


def small_batches(spark: SparkSession, rows: int = 1_000) -> None:
    """A setting for jobs over long texts: Arrow batches of at most ``rows`` rows, so that executors hold little of them at once.

    Results don't depend on it. Operators leave the session as it is; the queries and the pipeline, which own theirs, set it.
    """
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def pieces(batches: Iterable[pa.RecordBatch], column: int, most: int = 1 << 21) -> Iterator[pa.RecordBatch]:
    """The same rows in batches whose texts (strings or binaries of ``column``) take at most about ``most`` bytes, or a single row,
    so that a task's memory depends neither on the session's batch size nor on how long texts are."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        lo = 0
        while lo < len(sizes):
            hi = lo + max(1, int(np.searchsorted(np.cumsum(sizes[lo : lo + 10_000]), most, side="right")))
            yield batch.slice(lo, hi - lo)
            lo = hi


def in_pieces(texts: pa.Array, most: int = 1 << 21) -> Iterator[pa.Array]:
    """``pieces`` of one column."""
    for part in pieces([pa.RecordBatch.from_arrays([texts], ["x"])], 0, most):
        yield part.column(0)


def packed(df: DataFrame, name: str = "_row") -> Column:
    """All columns of ``df`` as one struct, so that columns added beside it cannot clash with them."""
    return F.struct(*[df[f"`{c}`"] for c in df.columns]).alias(name)


def stars(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of the edges (u, v) that reach a smaller one, each with the smallest that it reaches."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    root = np.arange(len(nodes))
    while len(a):
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while (root[root] != root).any():
            root = root[root]
        a, b = root[a], root[b]
        a, b = a[a != b], b[a != b]
    moved = root != np.arange(len(nodes))
    return nodes[moved], nodes[root[moved]]


def _joined(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def held(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(parts)
        return pa.RecordBatch.from_arrays([pa.array(x) for x in stars(table["u"].to_numpy(), table["v"].to_numpy())], ["u", "v"])

    parts, n = [], 0
    for batch in batches:
        while batch.num_rows:
            parts.append(batch.slice(0, TASK_EDGES - n))
            n, batch = n + parts[-1].num_rows, batch.slice(parts[-1].num_rows)
            if n == TASK_EDGES:
                yield held(parts)
                parts, n = [], 0
    if parts:
        yield held(parts)


def connected_components(edges: DataFrame, u: str, v: str) -> DataFrame:
    """Smallest reachable node of every node (a bigint) that has an edge.

    First each task joins the edges that it holds, TASK_EDGES at a time, so that they become stars. If one task held them all, that is the
    result; else the large-star and small-star steps alternate on what is left. Each round of these is joins and partial aggregates by
    node, and is written to the shared folder. Returns ``node`` and ``root`` for nodes other than the roots themselves. Self-loops
    and repeated edges are allowed; edges with a null end are ignored.
    """
    def state(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.coalesce(F.bit_xor(F.xxhash64("u", "v")), F.lit(0))).first())

    a, b = F.col(u), F.col(v)
    e = edges.select(F.greatest(a, b).cast("bigint").alias("u"), F.least(a, b).cast("bigint").alias("v")).where(a.isNotNull() & b.isNotNull() & (a != b))
    e = stored(e, "links")
    tasks = max(1, -(-e.count() // TASK_EDGES))
    joined = stored(e.coalesce(tasks).mapInArrow(_joined, "u bigint, v bigint"), "links")
    discard(e)
    e = joined
    if tasks == 1:
        return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
    seen = state(e)
    while seen[0]:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("u", "m").alias("m"))
        large = both.join(low, F.col("u") == F.col("k")).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), "m")
        near = large.join(low, F.col("u") == F.col("k")).where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        new = stored(near.unionByName(low.select(F.col("k").alias("u"), F.col("m").alias("v"))).distinct(), "links")
        discard(e)
        e, now = new, state(new)
        if now == seen:
            break
        seen = now
    return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
