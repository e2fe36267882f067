"""Mixing sources to target weights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fernlog.llm.common import WORD, packed, stored

#: Sources are broadcast up to this many; more are joined by shuffle, where a hot source is split by AQE.
BROADCAST_SOURCES = 100_000


def _unit(id_col: Column, seed: int) -> Column:
    """A number in [0, 1) from the id and the seed, the same in every run."""
    digits = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit("")))), 1, 12)
    return F.conv(digits, 16, 10).cast("double") / F.lit(float(16**12))


def ranked(df: DataFrame, order: list[Column]) -> DataFrame:
    """Adds ``rank`` (from 0) in the given order over all rows, without one task that sees them all."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parted = df.repartitionByRange(n, *order).sortWithinPartitions(*order)
    parted = stored(parted.withColumn("_at", F.monotonically_increasing_id()), "ranked")
    part = F.shiftright(F.col("_at"), 33)
    counts = parted.groupBy(part.alias("_part")).agg(F.count("*").alias("n")).collect()  # one row for each partition
    start, starts = 0, {}
    for r in sorted(counts, key=lambda r: r["_part"]):
        starts[r["_part"]] = start
        start += r["n"]
    table = F.create_map(*[F.lit(x) for kv in starts.items() for x in kv]) if starts else F.create_map(F.lit(0), F.lit(0))
    offset = table[part].cast("long")
    return parted.withColumn("rank", offset + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))).drop("_at")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3) -> DataFrame:
    """One row for each source: source, source_size, target.

    ``sizes`` has source and size. Sources by code point, null last, weigh ``weights`` in turn and share the sum of all
    sizes. A target stops at ``most`` times its source's size; the excess goes to the others by weight until none is
    above. Only the level (a number) comes to the driver, once for each round.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    weight = F.array(*map(F.lit, weights))[(F.col("rank") % len(weights)).cast("int")]
    by = ranked(totals, [F.col("source").asc_nulls_last()])
    by = by.select("source", "source_size", weight.alias("w"), (F.lit(most) * F.col("source_size")).alias("cap"))
    total = by.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("w"), F.lit(0))).first()
    level, held = (total[0] / total[1] if total[1] else 0.0), -1
    while True:
        over = F.col("cap") < F.col("w") * F.lit(level)
        n, cap, w = by.where(over).agg(F.count("*"), F.coalesce(F.sum("cap"), F.lit(0)), F.coalesce(F.sum("w"), F.lit(0))).first()
        if n == held or w == total[1]:
            break
        level, held = (total[0] - cap) / (total[1] - w), n
    target = F.least(F.col("w") * F.lit(level), F.col("cap").cast("double"))
    return by.select("source", "source_size", target.alias("target"))


def mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3, seed: int = 17, by_text: bool = False) -> DataFrame:
    """How often each document is taken so that sources meet their target shares of words.

    ``docs`` has doc_id, text, source and may have any other columns. Returns the struct ``_row`` of the input's
    columns, size (words), source_size, target (of the source), rate, copies = floor(rate), plus one more copy with
    probability rate - floor(rate), drawn from a hash of the seed and doc_id, and with ``by_text`` of the text as well, so that
    documents with null or repeated ids draw apart too.

    Null or empty texts have size 0. A null source is a source of its own and the last. A null doc_id draws as an
    empty id. Repeated rows draw alike; without ``by_text`` so do all rows of one id, which then may miss their source's target. A source without words has rate 0. An empty table gives an empty table.
    """
    drawn = F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.md5(F.coalesce("text", F.lit("")))) if by_text else F.col("doc_id")
    base = docs.select(packed(docs), F.col("doc_id").alias("id"), _unit(drawn, seed).alias("unit"), F.col("source"), F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"))
    targets = stored(source_targets(base.select("source", "size"), weights, most), "targets")
    side = targets.withColumnRenamed("source", "_source")
    if side.count() <= BROADCAST_SOURCES:
        side = F.broadcast(side)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    joined = base.join(side, F.col("source").eqNullSafe(F.col("_source"))).withColumn("rate", rate)
    whole = F.floor("rate")
    copies = whole + F.when(F.col("unit") < F.col("rate") - whole, 1).otherwise(0)
    return joined.select("_row", F.col("id").alias("doc_id"), "size", "source_size", "target", "rate", copies.cast("long").alias("copies"))


def emit(mixed: DataFrame) -> DataFrame:
    """The documents of the mix with the input's own columns, each as often as it is taken."""
    return mixed.where("copies > 0").select("_row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("_row.*")


ORACLE = r"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
             (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS w FROM d GROUP BY source),
c AS (SELECT *, 3 * source_size AS cap, sum(source_size) OVER () AS t, sum(w) OVER () AS tw FROM s),
o AS (SELECT *, row_number() OVER (ORDER BY cap / w, source NULLS LAST) AS k,
             coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pc,
             coalesce(sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pw FROM c),
v AS (SELECT *, CAST(t - pc AS DOUBLE) / CAST(tw - pw AS DOUBLE) AS lv FROM o),
l AS (SELECT arg_min(lv, k) FILTER (WHERE cap >= w * lv) AS level FROM v),
g AS (SELECT source, source_size, least(w * level, CAST(cap AS DOUBLE)) AS target FROM c, l),
r AS (SELECT d.doc_id, d.size, g.source_size, g.target,
             CASE WHEN g.source_size > 0 THEN g.target / g.source_size ELSE 0 END AS rate,
             CAST(('0x' || substr(md5('17:' || coalesce(CAST(d.doc_id AS VARCHAR), '')), 1, 12)) AS BIGINT) / 281474976710656.0 AS u
      FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, source_size, target,
       CAST(size * (floor(rate) + CASE WHEN CAST(u AS DOUBLE) < rate - floor(rate) THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM r
"""
