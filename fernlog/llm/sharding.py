"""Sharding by a consistent-hash ring with virtual nodes and bounded loads."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fernlog.llm.common import packed

#: Ring positions are 60-bit numbers.
_BITS = 60


def ring(shards: int, vnodes: int) -> tuple[list[int], list[int]]:
    """Positions of the virtual nodes in ring order, and the shard of each."""
    points = sorted((int(hashlib.md5(f"{s}/{v}".encode()).hexdigest()[:15], 16), s) for s in range(shards) for v in range(vnodes))
    return [p for p, _ in points], [s for _, s in points]


def place(counts: list[int], owners: list[int], caps: list[int]) -> list[tuple[int, int, int, int]]:
    """Ranges of keys and their shard: (arc, first rank, end rank, shard).

    In rounds, each virtual node in ring order takes what its shard still has room for, first the keys of lowest rank;
    the rest goes on to the next virtual node clockwise. It works on counts, so its size is that of the ring.
    """
    free, out = list(caps), []
    waiting = {a: [(a, 0, n)] for a, n in enumerate(counts) if n}
    while waiting:
        moved: dict[int, list] = {}
        for at in sorted(waiting):
            for arc, lo, hi in waiting[at]:
                took = min(hi - lo, free[owners[at]])
                if took:
                    free[owners[at]] -= took
                    out.append((arc, lo, lo + took, owners[at]))
                if lo + took < hi:
                    moved.setdefault((at + 1) % len(owners), []).append((arc, lo + took, hi))
        waiting = moved
    return sorted(out)


def capacities(rows: int, shards: int, slack: float) -> list[int]:
    """Rows that each shard may hold: its even share times 1 + slack; with slack 0 the shares add up to ``rows``."""
    even = [rows // shards + (s < rows % shards) for s in range(shards)]
    return even if slack == 0 else [int(-(-x * (1 + slack) // 1)) for x in even]


def shard(docs: DataFrame, shards: int = 40, vnodes: int = 64, slack: float = 0.0) -> DataFrame:
    """A shard and a slot for each row.

    Keys (hash of doc_id, the text's checksum and its size) lie on a ring with ``vnodes`` virtual nodes a shard; a key
    belongs to the next virtual node clockwise, and if that shard is full it goes on clockwise. Bounds count rows:
    with ``slack`` 0 the counts are at most one apart. Slots number the rows of a shard from 0 without gaps.

    Only the number of keys of each arc (shards x vnodes numbers) comes to the driver. Ranks are taken by arc, so that
    the largest task holds about one part in shards x vnodes of the rows.

    ``docs`` has doc_id and text and may have any other columns. Returns the struct ``_row`` of the input's columns,
    doc_id, size (UTF-8 bytes + 16), text_crc32, shard, slot. A null text has no bytes and checksum 0; a null doc_id is a
    key of its own; equal rows take adjoining places; an empty table gives an empty table.
    """
    points, owners = ring(shards, vnodes)
    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    key = F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.crc32(raw), F.octet_length(raw))
    at = np.array(points, dtype=np.int64)

    @F.pandas_udf("int")
    def arc_of(pos: pd.Series) -> pd.Series:
        return pd.Series((np.searchsorted(at, pos.to_numpy()) % len(at)).astype(np.int32))

    base = docs.select(packed(docs), F.col("doc_id"), (F.octet_length(raw) + 16).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"), F.shiftrightunsigned(key, 64 - _BITS).alias("pos"))
    base = base.withColumn("arc", arc_of("pos"))
    found = {r["arc"]: r["count"] for r in base.groupBy("arc").count().collect()}
    counts = [found.get(a, 0) for a in range(len(points))]
    first = np.concatenate([[0], np.cumsum(counts)])[:-1]
    parts = place(counts, owners, capacities(sum(counts), shards, slack)) or [(0, 0, 0, 0)]
    used = [0] * shards
    starts, to, slots = [], [], []
    for arc, lo, hi, s in parts:
        starts.append(int(first[arc]) + lo)
        to.append(s)
        slots.append(used[s])
        used[s] += hi - lo
    starts_, to_, slots_ = (np.array(x, dtype=np.int64) for x in (starts, to, slots))

    @F.pandas_udf("struct<shard int, slot bigint>")
    def placed(arc: pd.Series, rank: pd.Series) -> pd.DataFrame:
        g = first[arc.to_numpy()] + rank.to_numpy()
        i = np.searchsorted(starts_, g, side="right") - 1
        return pd.DataFrame({"shard": to_[i].astype(np.int32), "slot": slots_[i] + g - starts_[i]})

    rank = F.row_number().over(Window.partitionBy("arc").orderBy("pos", "doc_id", "text_crc32", "size")) - 1
    ranked = base.withColumn("rank", rank.cast("long")).withColumn("_to", placed("arc", "rank"))
    return ranked.select("_row", "doc_id", "size", "text_crc32", "_to.shard", "_to.slot")


