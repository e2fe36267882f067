"""Benchmark decontamination with SimHash over windows of the items' sizes. Built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fernlog.llm.common import ascii_lower, packed, stored, words

#: What may be broadcast, in rows; more is joined by shuffle.
BROADCAST_SHINGLES, BROADCAST_TEXTS = 1_000_000, 100_000
#: Hashes whose bits are summed in lanes at once; the sums of longer windows are added up in pieces of so many.
PIECE = 32_767


def _small(df: DataFrame, most: int) -> DataFrame:
    return F.broadcast(df) if df.count() <= most else df


def shingles(w: Column, width: int) -> Column:
    """64-bit hashes of the ``width``-word shingles in order, none for fewer words."""
    last = F.size(w) - width + 1
    shifted = [F.slice(w, k + 1, F.greatest(last, F.lit(0))) for k in range(width)]
    return F.transform(F.arrays_zip(*shifted), lambda x: F.xxhash64(x))


def _lanes(h: Column) -> list[Column]:
    """Sums of 16 numbers, each with four of the 64 bit counts in lanes of 16 bits."""
    lane = F.lit(0x0001000100010001)
    return [F.sum(F.shiftrightunsigned(h, j).bitwiseAND(lane)).alias(f"s{j}") for j in range(16)]


def _votes(j: int, lane: int) -> Column:
    return F.shiftrightunsigned(F.col(f"s{j}"), 16 * lane).bitwiseAND(F.lit(0xFFFF))


def _fingerprint(votes: dict[int, Column], count: Column) -> Column:
    """Bits that are set in over half of the shingles, from the votes for each bit."""
    out = F.lit(0).cast("long")
    for bit, n in votes.items():
        out = out.bitwiseOR(F.shiftleft(F.when(n * 2 > count, 1).otherwise(0).cast("long"), bit))
    return out


def _simhash(rows: DataFrame, keys: list[str], longest: int, piece: int = PIECE) -> DataFrame:
    """``rows`` has ``keys`` and ``hs`` (at most ``longest`` hashes); adds ``fp``. ``piece`` is at most PIECE."""
    places = [(j, lane) for j in range(16) for lane in range(4)]
    if longest <= piece:
        summed = rows.select(*keys, F.explode("hs").alias("h")).groupBy(*keys).agg(*_lanes(F.col("h")), F.count("*").alias("c"))
        return summed.select(*keys, _fingerprint({j + 16 * lane: _votes(j, lane) for j, lane in places}, F.col("c")).alias("fp"))
    parts = rows.select(*keys, F.posexplode("hs").alias("at", "h")).groupBy(*keys, F.floor(F.col("at") / piece).alias("part"))
    parts = parts.agg(*_lanes(F.col("h")), F.count("*").alias("c"))
    summed = parts.groupBy(*keys).agg(*[F.sum(_votes(j, lane)).alias(f"b{j + 16 * lane}") for j, lane in places], F.sum("c").alias("c"))
    return summed.select(*keys, _fingerprint({bit: F.col(f"b{bit}") for bit in range(64)}, F.col("c")).alias("fp"))


def _blocks(fp: Column, radius: int) -> Column:
    """``radius`` + 1 blocks of the bits: fingerprints within the radius agree in one of them at least."""
    n = radius + 1
    edges = [64 * k // n for k in range(n + 1)]
    return F.array(*[F.struct(F.lit(k).alias("block"), F.shiftrightunsigned(fp, lo).bitwiseAND(F.lit((1 << (hi - lo)) - 1)).alias("bits")) for k, (lo, hi) in enumerate(zip(edges, edges[1:], strict=False))])


def _items(benchmark: DataFrame, width: int) -> DataFrame:
    """The whole items: item_id, n (words), hs (shingle hashes)."""
    w = benchmark.select("item_id", words(ascii_lower(F.col("text"))).alias("w")).where(F.size("w") >= width)
    return w.select("item_id", F.size("w").alias("n"), shingles(F.col("w"), width).alias("hs"))


def _starts(hits: DataFrame, width: int, threshold: float) -> DataFrame:
    """Windows that may reach the threshold: key, n, start. ``hits`` has key, size, at, n.

    Windows of m shingles and items of k have at least ``threshold`` only if they share threshold / (1 + threshold) x
    (m + k) shingles, and share no more than the window has hits: so many hits in a row must lie in the window.
    """
    m = F.least(F.col("n"), F.col("size")) - width + 1
    need = F.greatest(F.lit(1), F.ceil((m + F.col("n") - width + 1) * (threshold / (1 + threshold)) - 1e-6).cast("int"))
    own = hits.groupBy("key", "n", "size").agg(F.array_sort(F.collect_list("at")).alias("ats"))
    own = own.withColumns({"m": m, "need": need}).where(F.size("ats") >= F.col("need"))
    first, last = F.col("a"), F.get("ats", F.col("i") + F.col("need") - 1)
    runs = own.select("*", F.posexplode("ats").alias("i", "a")).where(last - first < F.col("m"))
    low = F.greatest(F.lit(0), last - F.col("m") + 1)
    high = F.least(first, F.greatest(F.lit(0), F.col("size") - F.col("n")))
    runs = runs.select("key", "n", low.alias("low"), high.alias("high")).where("low <= high")
    return runs.select("key", "n", F.explode(F.sequence("low", "high")).alias("start")).distinct()


def leaks(docs: DataFrame, benchmark: DataFrame, width: int = 5, threshold: float = 0.8, radius: int = 19) -> DataFrame:
    """Benchmark items found in documents: doc_id, item_id, similarity, start_word, n_words, one row for each pair.

    For each item size the document's windows of as many words are fingerprinted (SimHash of the ``width``-word shingles,
    A-Z in lower case) where they hold enough shingles of items for the threshold; others cannot reach it. Fingerprints
    within ``radius`` bits of an item of that size are found through ``radius`` + 1 blocks of bits, of which one must
    agree. A candidate counts if the exact weighted Jaccard similarity of the shingles (weights: occurrences) is at
    least ``threshold``. At similarity 0.8 fingerprints differ in 10 of 64 bits on average, so that a radius of 19 misses
    less than one window in a thousand at the threshold itself and none of an exact copy. Of several windows the best,
    then the first, is reported.

    Texts that are equal are searched once. ``docs`` has doc_id and text, ``benchmark`` item_id and text; other columns are
    ignored. Null texts and texts or items of fewer than ``width`` words match nothing; documents shorter than an item are
    compared whole. Items of any length are compared whole. Repeated rows and null ids are reported like any other. Empty
    tables give an empty table.
    """
    items = stored(_items(benchmark, width), "items")
    longest = items.agg(F.coalesce(F.max("n"), F.lit(0))).first()[0]
    texts = docs.where(F.col("text").isNotNull()).select("doc_id", F.unhex(F.md5(F.col("text").cast("binary"))).alias("key"), "text")
    known = _small(stored(items.select(F.explode("hs").alias("h"), "n").distinct(), "shingles"), BROADCAST_SHINGLES)

    # where the documents hold shingles of items: the only look at all texts
    split = texts.select("key", words(ascii_lower(F.col("text"))).alias("w")).where(F.size("w") >= width)
    found = split.select("key", F.size("w").alias("size"), F.posexplode(shingles(F.col("w"), width)).alias("at", "h"))
    hits = stored(found.join(known, "h").select("key", "size", "at", "n").distinct(), "hits")

    # windows that hold enough hits
    windows = stored(_starts(hits, width, threshold), "starts")
    wanted = stored(windows.select("key").distinct(), "wanted")
    few = wanted.count() <= BROADCAST_TEXTS
    own = texts.select("key", "text").join(F.broadcast(wanted) if few else wanted, "key", "left_semi")
    own = own.groupBy("key").agg(F.first("text").alias("text"))
    hashed = own.select("key", words(ascii_lower(F.col("text"))).alias("w")).select(F.col("key").alias("_key"), shingles(F.col("w"), width).alias("all"))
    slices = windows.join(hashed, F.col("key") == F.col("_key")).select("key", "n", "start", F.slice("all", F.col("start") + 1, F.col("n") - width + 1).alias("hs"))
    slices = stored(slices, "windows")

    # candidates: the same size, one block in common, then the distance
    fps = _simhash(slices, ["key", "n", "start"], longest).select("key", "n", "start", "fp", F.explode(_blocks(F.col("fp"), radius)).alias("b"))
    theirs = _simhash(items, ["item_id", "n"], longest).select("item_id", F.col("n").alias("_n"), F.col("fp").alias("_fp"), F.explode(_blocks(F.col("fp"), radius)).alias("_b"))
    near = fps.join(theirs, (F.col("n") == F.col("_n")) & (F.col("b.block") == F.col("_b.block")) & (F.col("b.bits") == F.col("_b.bits")))
    near = near.where(F.bit_count(F.col("fp").bitwiseXOR(F.col("_fp"))) <= radius)
    pairs = near.select("key", "n", "start", "item_id").distinct()

    # the exact similarity
    theirs = items.select("item_id", "n", F.size("hs").alias("of_item"), F.explode("hs").alias("h")).groupBy("item_id", "n", "of_item", "h").agg(F.count("*").alias("c"))
    sized = pairs.join(slices, ["key", "n", "start"]).select("key", "n", "start", "item_id", F.size("hs").alias("of_window"), F.explode("hs").alias("h"))
    counted = sized.groupBy("key", "n", "start", "item_id", "of_window", "h").agg(F.count("*").alias("_c"))
    same = F.sum(F.least("c", "_c"))
    join = counted.join(theirs.select(F.col("item_id").alias("_i"), F.col("h").alias("_h"), "c", "of_item"), F.col("item_id").eqNullSafe(F.col("_i")) & (F.col("h") == F.col("_h")))
    scored = join.groupBy("key", "n", "start", "item_id", "of_window", "of_item").agg(same.alias("same"))
    scored = scored.withColumn("similarity", F.col("same") / (F.col("of_window") + F.col("of_item") - F.col("same"))).where(F.col("similarity") >= threshold)
    best = scored.groupBy("key", "item_id").agg(F.max(F.struct("similarity", (-F.col("start")).alias("neg"), "of_window")).alias("m"))
    best = stored(best.select(F.col("key").alias("_key"), "item_id", F.col("m.similarity").alias("similarity"), (-F.col("m.neg")).alias("start_word"), (F.col("m.of_window") + width - 1).alias("n_words")), "leaks")
    return texts.select("doc_id", "key").join(_small(best, BROADCAST_TEXTS), F.col("key") == F.col("_key")).select("doc_id", "item_id", "similarity", "start_word", "n_words")


def clean(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents, with all their columns, that hold no item. Null texts stay."""
    key = F.md5(F.col("text").cast("binary"))
    bad = leaks(docs.select(key.alias("doc_id"), "text"), benchmark, **options)  # equal texts share their fate
    bad = stored(bad.select(F.col("doc_id").alias("_bad")).distinct(), "bad")
    keyed = docs.select(packed(docs), key.alias("_key"))
    return keyed.join(_small(bad, BROADCAST_TEXTS), F.col("_key") == F.col("_bad"), "left_anti").select("_row.*")
