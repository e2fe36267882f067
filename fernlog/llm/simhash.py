"""SimHash near-duplicates by ball hashing that meets in the middle."""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fernlog.llm.common import connected_components, discard, packed, stored

#: Variants that one bucket should hold, and that one step of a task may hold in memory.
BUCKET_VARIANTS, STEP_VARIANTS = 1 << 21, 1 << 21
#: Pieces of longer fingerprints: how many a bucket holds at PIECE_RADIUS flips (twice as many for each flip less, as they have fewer
#: variants), and variants or pairs of one step.
BUCKET_PIECES, STEP_PIECES, PIECE_RADIUS = 1 << 18, 1 << 18, 4
#: Near copies: flips of a piece, and how rarely a pair at the threshold, which differs in such a share of the bits, may go unseen. The
#: second is for sets of four and five shingles.
NEAR_RADIUS, UNSEEN = 2, {0.152: 1e-4, 0.19: 1e-2}
#: Share of bits in which two near copies may differ at most: of the whole long fingerprint, and of its first 64 bits.
#: At similarity 0.8 it is 0.15 on average and, for sets of four and five shingles, 0.19.
APART, APART_64 = 0.25, 23
#: Rows of keys that are broadcast to the texts; more are joined by a shuffle.
BROADCAST_ROWS = 500_000
#: With how many of those that follow it among a variant's fingerprints, by nearness, one may be linked first.
AHEAD = 4
#: Bits of a set's sketch, in words of 64. Sets above SKETCHED hashes are sketched by a sample, whose test a pair at the threshold
#: fails no oftener than one outside so many standard deviations.
SKETCH, SKETCHED, DEVIATIONS = 4, 400, 5
WORDS = [f"word{k}" for k in range(SKETCH)]
#: Hashes of a set that are mixed at a time.
MIXED = 1_024


def simhash(text: bytes, width: int = 4, seed: int = 42) -> int:
    """64-bit SimHash of the word shingles, repeats included; 0 for no word. A-Z count as lower case.

    Shorter texts than ``width`` words have one shingle. A bit is set if it is set in over half of the shingles' XXH64.
    """
    found = text.lower().split()  # bytes: ASCII only, splits at \x20 and \x09-\x0D
    if not found:
        return 0
    joined = b" ".join(found)
    ends = list(itertools.accumulate(len(w) + 1 for w in found))
    starts = [0, *ends[:-1]]
    last = max(1, len(found) - width + 1)
    digest = xxhash.xxh64_digest
    hashes = b"".join([digest(joined[s : e - 1], seed) for s, e in zip(starts[:last], ends[min(width, len(found)) - 1 :], strict=True)])
    bits = np.unpackbits(np.frombuffer(hashes, np.uint8).reshape(-1, 8), axis=1)
    whole = len(bits) // 255 * 255
    votes = bits[:whole].reshape(-1, 255, 64).sum(axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64) + bits[whole:].sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(votes * 2 > len(bits)).tobytes(), "big")


def fingerprint(col: Column, width: int = 4, seed: int = 42) -> Column:
    """SimHash of a text column as a signed 64-bit number; null counts as an empty text."""

    @F.arrow_udf("bigint")
    def of(texts: pa.Array) -> pa.Array:
        found = [simhash(t.as_buffer().to_pybytes() if t.is_valid else b"", width, seed) for t in texts]
        return pa.array(np.array(found, np.uint64).view(np.int64))

    return of(col.cast("binary"))


def _masks(bits: int, most: int) -> np.ndarray:
    """All masks over the low ``bits`` bits with at most ``most`` bits set, fewest first."""
    sets = itertools.chain.from_iterable(itertools.combinations(range(bits), k) for k in range(most + 1))
    return np.array([sum(1 << b for b in s) for s in sets], np.uint64)


def local_roots(fps: np.ndarray, room: np.ndarray, bits: int, radius: int) -> np.ndarray:
    """For each fingerprint the place of a fingerprint that it is linked to through shared variants, maybe its own.

    The fingerprints agree in all but the low ``bits`` bits once ``len(room)`` flips are made there; ``room`` says how
    many flips each has left.
    """
    root = np.arange(len(fps))
    for at, o in _meetings(fps, np.arange(len(fps)), room, bits):
        head = np.concatenate([[True], at[1:] != at[:-1]])
        first = o[np.maximum.accumulate(np.where(head, np.arange(len(o)), 0))]
        # two that share a variant differ in at most twice the half radius; the pairs are verified all the same
        ok = np.bitwise_count(fps[first] ^ fps[o]) <= radius
        _unite(root, first[ok], o[ok])
    return root


def _unite(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    while True:
        _find(root)
        ra, rb = root[a], root[b]
        if np.array_equal(ra, rb):
            return
        np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))


def _top(root: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The roots of some places; it looks at no other places than theirs and those above them."""
    while True:
        up = root[x]
        if np.array_equal(up, x):
            return x
        x = up


def _join(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """As ``_unite``, at the cost of these pairs, however many places there are."""
    while len(a):
        ra, rb = _top(root, a), _top(root, b)
        root[a], root[b] = ra, rb
        if np.array_equal(ra, rb):
            return
        np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))


def _find(root: np.ndarray) -> np.ndarray:
    while True:
        up = root[root]
        if np.array_equal(up, root):
            return root
        root[:] = up


def _meetings(fps: np.ndarray, who: np.ndarray, room: np.ndarray, bits: int, most: int = STEP_VARIANTS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Variants that two fingerprints or more share: numbers of the variants in order, and who has them.

    Variants are made, sorted and compared; what needs more than ``most`` of them at once is first split by further
    bits, the same way as the buckets were.
    """
    if len(who) < 2:
        return
    sizes = np.array([sum(math.comb(bits, k) for k in range(r + 1)) for r in range(int(room.max()) + 1)])
    if sizes[room].sum() > most and bits > 4:
        low = bits - 4
        top = (fps[who] >> np.uint64(low)) & np.uint64(15)
        for at in range(16):
            left = room - np.bitwise_count(top ^ np.uint64(at)).astype(room.dtype)
            ok = left >= 0
            yield from _meetings(fps, who[ok], left[ok], low, most)
        return
    low = np.uint64((1 << bits) - 1)
    variants, owners = [], []
    for r in np.unique(room):
        own = who[room == r]
        masks = _masks_of(bits, int(r))
        variants.append(((fps[own] & low)[:, None] ^ masks[None, :]).ravel())
        owners.append(np.repeat(own, len(masks)))
    v, o = np.concatenate(variants), np.concatenate(owners)
    if bits <= 32:  # a variant and its owner are one number, sorted at once
        both = np.sort(v << np.uint64(32) | o.astype(np.uint64))
        v = both >> np.uint64(32)
        new = v[1:] != v[:-1]
        hit = ~(np.append(True, new) & np.append(new, True))
        v, o = v[hit], (both[hit] & np.uint64(0xFFFFFFFF)).astype(np.int64)
        if len(v):
            yield np.cumsum(np.append(False, v[1:] != v[:-1])), o
        return
    s = np.sort(v)
    twice = np.unique(s[1:][s[1:] == s[:-1]])
    if not len(twice):
        return
    at = np.searchsorted(twice, v)
    at[at == len(twice)] = 0
    hit = twice[at] == v
    at, o = at[hit], o[hit]
    order = np.lexsort((o, at))
    yield at[order], o[order]


#: Which of the pairs (a, b) of places may be near copies.
May = Callable[[np.ndarray, np.ndarray], np.ndarray]


def _likely(checks: np.ndarray, may: May | None, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the pairs (a, b) of places those whose checks are near and that ``may`` leaves, smaller place first."""
    ok = (a != b) & (np.bitwise_count(checks[a] ^ checks[b]) <= APART_64)
    a, b = a[ok], b[ok]
    if may:
        ok = may(a, b)
        a, b = a[ok], b[ok]
    return np.minimum(a, b), np.maximum(a, b)


def _across(at: np.ndarray, o: np.ndarray, roots: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of the places ``o`` that share a variant and have different ``roots``, so many at once."""
    order = np.lexsort((roots, at))
    at, o, roots = at[order], o[order], roots[order]
    new = np.concatenate([at[1:] != at[:-1], [True]])
    ends = np.flatnonzero(new) + 1
    runs = np.flatnonzero(new | np.append(roots[1:] != roots[:-1], True)) + 1
    places = np.arange(len(o))
    run_end, end = runs[np.searchsorted(runs, places, side="right")], ends[np.searchsorted(ends, places, side="right")]
    cum = np.cumsum(end - run_end)
    for lo in range(0, int(cum[-1]), STEP_PIECES):
        pair = np.arange(lo, min(lo + STEP_PIECES, int(cum[-1])))
        i = np.searchsorted(cum, pair, side="right")
        yield o[i], o[end[i] - (cum[i] - pair)]


def _collect(found: list[np.ndarray], codes: np.ndarray) -> None:
    """Add ``codes`` to those found; what was found again and again is held once."""
    found.append(_distinct(codes))
    if sum(map(len, found[1:])) > max(STEP_PIECES, len(found[0])):
        found[:] = [_distinct(np.concatenate(found))]


def local_forest(values: np.ndarray, checks: np.ndarray, room: np.ndarray, bits: int, may: May | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (a, b) of places that join all that share variants, whose checks are near and that ``may`` leaves: a spanning forest.

    Of a variant's places those that follow each other by check, and each with the first, are candidates; then, for any two of the groups
    that this makes, the nearest pair of the variant. Of up to AHEAD + 1 places the first of these are all pairs. The forest takes the
    nearest candidates first.
    """
    n, found, root = len(values), [np.zeros(0, np.int64)], np.arange(len(values))
    order = np.argsort(checks, kind="stable")
    values, checks, room = values[order], checks[order], room[order]
    some = may and (lambda a, b: may(order[a], order[b]))
    for at, o in _meetings(values, np.arange(n), room, bits, STEP_PIECES):
        for k in range(1, AHEAD + 1):
            ok = np.flatnonzero(at[k:] == at[:-k])
            a, b = _likely(checks, some, o[ok], o[ok + k])
            _collect(found, a * n + b)
            _join(root, a, b)
        many = (np.bincount(at) > AHEAD + 1)[at]
        at, o = at[many], o[many]
        if not len(o):
            continue
        head = np.concatenate([[True], at[1:] != at[:-1]])
        first = o[np.maximum.accumulate(np.where(head, np.arange(len(o)), 0))]
        a, b = _likely(checks, some, first, o)
        _collect(found, a * n + b)
        _join(root, a, b)
        for a, b in _across(at, o, _top(root, o)):
            a, b = _likely(checks, some, a, b)
            by = np.argsort(np.bitwise_count(checks[a] ^ checks[b]), kind="stable")
            a, b = a[by], b[by]
            x, y = _top(root, a), _top(root, b)
            _, firsts = np.unique(np.minimum(x, y) * n + np.maximum(x, y), return_index=True)
            a, b = a[firsts], b[firsts]
            _collect(found, a.astype(np.int64) * n + b)
            _join(root, a, b)
    codes = _distinct(np.concatenate(found))
    a, b = codes // max(n, 1), codes % max(n, 1)
    far = np.bitwise_count(checks[a] ^ checks[b])
    ranked = np.lexsort((checks[b], checks[a], far))
    a, b = a[ranked], b[ranked]
    root, kept = np.arange(n), np.zeros(len(a), bool)
    left = np.arange(len(a))
    while len(left):  # each group takes its nearest pair to another one
        best = np.full(n, len(a))
        np.minimum.at(best, root[a[left]], left)
        np.minimum.at(best, root[b[left]], left)
        take = np.unique(best[best < len(a)])
        kept[take] = True
        _unite(root, a[take], b[take])
        left = left[root[a[left]] != root[b[left]]]
    a, b = order[a[kept]], order[b[kept]]
    return np.minimum(a, b), np.maximum(a, b)


def _level(sizes: np.ndarray) -> np.ndarray:
    """Of a set of so many hashes those go into its sketch whose last so many bits are zero."""
    return np.ceil(np.log2(np.maximum(sizes, SKETCHED) / SKETCHED)).astype(np.int64)


def sketch(found: np.ndarray) -> np.ndarray:
    """For each leading byte of a hash whether the set has an odd number of such hashes."""
    some = found[found & np.uint64((1 << int(_level(np.array(len(found))))) - 1) == 0]
    odd = np.bincount((some >> np.uint64(56)).astype(np.int64), minlength=64 * SKETCH).astype(np.uint8) & 1
    return np.packbits(odd).view(">u8").astype(np.uint64)


def may_reach(sizes: np.ndarray, sketches: np.ndarray, a: np.ndarray, b: np.ndarray, threshold: float) -> np.ndarray:
    """Which pairs (a, b) of places may have the similarity, by the sizes and sketches of their sets.

    Two sets at the threshold have at most (1 - t) / (1 + t) of both sizes in hashes that only one of them has. A bit that differs stands
    for one such hash at least, so that sets of at most SKETCHED hashes are told apart without error. Of sampled ones the differing bits
    are as good as binomial; sets sampled at different rates aren't told apart.
    """
    x, y = sizes[a], sizes[b]
    ok, level, bits = np.minimum(x, y) >= threshold * np.maximum(x, y) - 1e-6, _level(x), 64 * SKETCH
    gap = (x + y) * (1 - threshold) / (1 + threshold)
    odd = (1 - np.exp(-2 * gap / 2.0**level / bits)) / 2
    most = np.where(level == 0, gap, bits * odd + DEVIATIONS * np.sqrt(bits * odd * (1 - odd))) + 1e-6
    apart = sum(np.bitwise_count(w[a] ^ w[b]).astype(np.int64) for w in sketches)
    return ok & ((apart <= most) | (level != _level(y)))


def apart_pairs(values: np.ndarray, checks: np.ndarray, roots: np.ndarray, room: np.ndarray, bits: int, may: May | None = None) -> tuple[np.ndarray, np.ndarray]:
    """All pairs (a, b) of places with different roots that share a variant, whose checks are near and that ``may`` leaves."""
    n, found = len(values), [np.zeros(0, np.int64)]
    for at, o in _meetings(values, np.arange(n), room, bits, STEP_PIECES):
        for a, b in _across(at, o, roots[o]):
            a, b = _likely(checks, may, a, b)
            _collect(found, a.astype(np.int64) * n + b)
    codes = _distinct(np.concatenate(found))
    return codes // max(n, 1), codes % max(n, 1)


_MASKS: dict[tuple[int, int], np.ndarray] = {}


def _masks_of(bits: int, most: int) -> np.ndarray:
    if (bits, most) not in _MASKS:
        _MASKS[bits, most] = _masks(bits, most)
    return _MASKS[bits, most]


def links(fps: DataFrame, radius: int = 4) -> DataFrame:
    """Links (fp, other) between distinct fingerprints that connect all that differ in at most ``radius`` bits.

    ``fps`` has distinct non-null ``fp``. Every fingerprint stands for all its variants within half the radius; two
    within the radius share one in the middle. Variants are shuffled by their leading bits: a fingerprint goes once to
    each bucket that one of its variants falls in, with the flips that it has left, and the bucket's task makes the
    variants. The number of leading bits follows the number of fingerprints, so buckets keep their size. Fingerprints
    that share a variant are linked to one of them, not pair by pair.
    """
    if radius % 2 or not 0 <= radius <= 8:
        raise ValueError("the radius is an even number up to 8")
    half, n = radius // 2, fps.count()
    every = n * sum(math.comb(64, k) for k in range(half + 1))
    t = min(30, max(4, math.ceil(math.log2(max(1, every) / BUCKET_VARIANTS)))) if every else 4
    low = 64 - t
    masks = F.array(*[F.lit(int(m)) for m in _masks(t, half)])
    parts = fps.select("fp", F.explode(masks).alias("flip"))
    bucket = F.shiftrightunsigned("fp", low).bitwiseXOR(F.col("flip"))
    parts = parts.select("fp", bucket.alias("bucket"), (F.lit(half) - F.bit_count("flip")).cast("int").alias("room"))

    def meet(group: pd.DataFrame) -> pd.DataFrame:
        own = group["fp"].to_numpy()
        root = local_roots(own.view(np.uint64), group["room"].to_numpy().astype(np.int64), low, radius)
        moved = root != np.arange(len(root))
        return pd.DataFrame({"fp": own[moved], "other": own[root[moved]]})

    return parts.groupBy("bucket").applyInPandas(meet, "fp bigint, other bigint")


def near_duplicates(docs: DataFrame, radius: int = 4, width: int = 4, seed: int = 42, rows: bool = True) -> DataFrame:
    """Groups of documents whose fingerprints are linked, directly or through others, at ``radius`` bits or fewer.

    ``docs`` has doc_id and text and may have any other columns. Returns the struct ``_row`` of the input's columns
    (with ``rows``), doc_id, fp, component_id (smallest doc_id of the group) and keep: true for one row of each group,
    that of the smallest doc_id. Null and empty texts have fingerprint 0 and are linked like any other. Null doc_ids come
    after all others, and are the component_id only of groups that have no other. Repeated rows are duplicates: one is
    kept. Very long texts count whole. An empty table gives an empty table.
    """
    columns = ([packed(docs)] if rows else []) + [F.col("doc_id"), fingerprint(F.col("text"), width, seed).alias("fp")]
    base = stored(docs.select(*columns).withColumn("_uid", F.monotonically_increasing_id()), "fingerprints")
    rank = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("_uid").alias("uid"))
    fps = stored(base.groupBy("fp").agg(F.min(rank).alias("low")), "distinct")
    roots = connected_components(links(fps.select("fp"), radius), "fp", "other")
    rooted = fps.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    lows = rooted.groupBy(F.col("root").alias("r")).agg(F.min("low").alias("first"))
    groups = rooted.join(lows, F.col("root") == F.col("r")).select(F.col("fp").alias("_fp"), "first")
    groups = stored(groups, "groups")
    joined = base.join(groups, F.col("fp") == F.col("_fp"))
    keep = (F.col("_uid") == F.col("first.uid")).alias("keep")
    return joined.select(*(["_row"] if rows else []), "doc_id", "fp", F.col("first.id").alias("component_id"), keep)


def shingle_set(text: bytes | None, width: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles; one for a text of fewer words, none for no word. A-Z count as lower case.

    Words are hashed once each, and a shingle's hash is made of theirs.
    """
    w = (text or b"").lower().split()  # bytes: ASCII only, splits at \x20 and \x09-\x0D
    if not w:
        return np.zeros(0, np.uint64)
    h = np.frombuffer(b"".join(map(xxhash.xxh64_digest, w)), ">u8").astype(np.uint64)
    last, n = max(1, len(w) - width + 1), min(width, len(w))
    weights = _mixed(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
    return _distinct(_mixed(sum(h[k : k + last] * weights[k] for k in range(n))))


def _mixed(h: np.ndarray) -> np.ndarray:
    """``h`` with the bits of each number mixed (splitmix), in its place."""
    t = h >> np.uint64(30)
    h ^= t
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= np.right_shift(h, np.uint64(27), out=t)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= np.right_shift(h, np.uint64(31), out=t)
    return h


def _distinct(x: np.ndarray) -> np.ndarray:
    """``np.unique`` by a sort, which for numbers of any order is several times faster than by the table that it uses."""
    x = np.sort(x)
    return x[np.append(True, x[1:] != x[:-1])] if len(x) else x


def long_fingerprint(found: np.ndarray, words: int) -> np.ndarray:
    """SimHash of a set of hashes in so many numbers of 64 bits, each from another mix of the hashes."""
    seeds = np.arange(1, words + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    votes = np.zeros(64 * words, np.int64)
    for lo in range(0, len(found), MIXED):
        votes += _column_sums(_mixed(found[lo : lo + MIXED, None] + seeds))
    return np.packbits(votes * 2 > len(found)).view(">u8").astype(np.uint64)


def _column_sums(h: np.ndarray) -> np.ndarray:
    """How many rows have each bit of the columns. Three rows become their sum's two binary digits as long as there are many rows."""
    sums, weight = np.zeros(64 * h.shape[1], np.int64), 1
    while True:
        carries = []
        while len(h) > 96:
            m = len(h) // 3
            a, b, c = h[:m], h[m : 2 * m], h[2 * m : 3 * m]
            x = a ^ b
            carries.append(a & b | x & c)
            h = np.concatenate([x ^ c, h[3 * m :]])
        sums += np.unpackbits(h.astype(">u8").view(np.uint8), axis=1).sum(axis=0, dtype=np.uint8) * np.int64(weight)
        if not carries:
            return sums
        h, weight = np.concatenate(carries), 2 * weight


def pieces_of(texts: int) -> tuple[int, int]:
    """Bits of a piece and number of pieces for so many texts.

    Longer pieces keep chance meetings in step with the texts, which meet in classes of sizes. There are so many that two texts at similarity
    0.8 are within NEAR_RADIUS in none of them no oftener than UNSEEN says. Two lie in each number of the long fingerprint.
    """
    bits = min(32, 24 + 2 * max(0, math.ceil(math.log2(max(1, texts))) - 24))
    near = {p: sum(math.comb(bits, k) * p**k * (1 - p) ** (bits - k) for k in range(NEAR_RADIUS + 1)) for p in UNSEEN}
    pieces = max(math.ceil(math.log(UNSEEN[p]) / math.log(1 - near[p])) for p in UNSEEN)
    return bits, pieces + pieces % 2


def _signatures(col: Column, width: int, words: int) -> Column:
    """A number for the whole shingle set, the set's size and sketch, and its long fingerprint. The empty set has the number alone."""

    @F.arrow_udf("array<bigint>")
    def of(texts: pa.Array) -> pa.Array:
        out = []
        for t in texts:
            found = shingle_set(t.as_buffer().to_pybytes() if t.is_valid else None, width)
            own = [np.array([xxhash.xxh64_intdigest(found.tobytes())], np.uint64)]
            if len(found):
                own += [np.array([len(found)], np.uint64), sketch(found), long_fingerprint(found, words)]
            out.append(np.concatenate(own).view(np.int64))
        return pa.array(out, pa.list_(pa.int64()))

    return of(col.cast("binary"))


def _sets(col: Column, width: int) -> Column:
    @F.arrow_udf("array<bigint>")
    def of(texts: pa.Array) -> pa.Array:
        return pa.array([shingle_set(t.as_buffer().to_pybytes() if t.is_valid else None, width).view(np.int64) for t in texts], pa.list_(pa.int64()))

    return of(col.cast("binary"))


def dealing(texts: int, bits: int, radius: int = PIECE_RADIUS) -> tuple[int, int, int, int]:
    """How the pieces of so many texts go to buckets: blocks, bits of a block that a bucket's pieces agree in, further bits that its variants
    agree in, and bits that are left.

    Up to four buckets a piece goes to each that one of its variants falls in. For more of them this takes ever more copies of a row (22 for 64
    buckets at four flips), while pieces within the radius agree in one of as many blocks and one more, whatever the buckets: five copies, or
    three at two flips.
    """
    t = min(16, max(0, math.ceil(math.log2(max(1, texts) / (BUCKET_PIECES << PIECE_RADIUS - radius)))))
    blocks = 1 if t <= 2 else radius + 1
    same = 0 if blocks == 1 else min(t, bits // blocks)
    return blocks, same, t - same, bits - t


def _dealt(fps: DataFrame, columns: list[str], bits: int, texts: int, radius: int = PIECE_RADIUS) -> tuple[DataFrame, int]:
    """The pieces of ``fps`` as value (without the bits that its bucket agrees in), bucket and room, with ``columns``; and the bits that are left.

    Pieces of different places, or of different values of a column ``kind``, don't meet.
    """
    blocks, same, more, low = dealing(texts, bits, radius)
    half, starts = radius // 2, [k * (bits // blocks) for k in range(blocks)]
    kind = F.col("kind") if "kind" in fps.columns else F.lit(0)
    v, piece = F.col("v"), F.col("piece") + F.col("before")
    cut = [
        F.struct(
            (F.shiftleft((piece * blocks + k).cast("bigint"), same) + F.shiftrightunsigned(v, at).bitwiseAND((1 << same) - 1)).alias("key"),
            F.shiftleft(F.shiftrightunsigned(v, at + same), at).bitwiseOR(v.bitwiseAND((1 << at) - 1)).alias("value"),
        )
        for k, at in enumerate(starts)
    ]
    masks = F.array(*[F.lit(int(m)) for m in _masks(more, half)])
    parts = fps.select(*columns, (kind * F.size("pieces")).alias("before"), F.posexplode("pieces").alias("piece", "v"))
    parts = parts.select(*columns, F.explode(F.array(*cut)).alias("c"))
    parts = parts.select(*columns, "c.*", F.explode(masks).alias("flip"))
    bucket = F.shiftleft("key", more) + F.shiftrightunsigned("value", low).bitwiseXOR(F.col("flip"))
    return parts.select(*columns, "value", bucket.alias("bucket"), (F.lit(half) - F.bit_count("flip")).cast("int").alias("room")), low


def _classes(fps: DataFrame, threshold: float) -> tuple[list[int], int]:
    """The smallest size of each class of sizes but the first, and about how many texts of the largest class meet.

    A step of sizes that may be similar is never cut, so that a text meets in its class and at most the one before it. A class takes as many
    steps as half a bucket holds.
    """
    step = F.floor(F.log("size") / -math.log(threshold) + 1e-9)
    counts = fps.groupBy(step.alias("step")).agg(F.count("*").alias("n"), F.min("size").alias("low")).orderBy("step").collect()
    starts, held, most = [], [0], BUCKET_PIECES << PIECE_RADIUS - NEAR_RADIUS
    for _, n, low in counts:
        if held[-1] and held[-1] + n > most // 2:
            starts.append(low)
            held[-1] += n  # those that meet the class before
            held.append(0)
        held[-1] += n
    return starts, max(held)


def _met(fps: DataFrame, bits: int, threshold: float) -> DataFrame:
    """Pairs (a, b) of fingerprints that meet in a piece and may have the similarity by their sizes and sketches: forests of them, or, with a
    column ``root``, all pairs of different roots.

    ``fps`` has fp, size, the words of the sketch and the long fingerprint. Sets at the similarity have about the same size, so that texts
    meet in classes of sizes: each in its own and in that of the smallest size that it may be similar to.
    """
    rooted = "root" in fps.columns
    starts, most = _classes(fps, threshold)

    def of(size: Column) -> Column:
        return F.size(F.filter(F.array(*[F.lit(x) for x in starts]).cast("array<bigint>"), lambda x: x <= size))

    halves = F.flatten(F.transform("long", lambda w: F.array(F.shiftrightunsigned(w, 32), w).cast("array<bigint>")))
    pieces = F.transform(halves, lambda w: w.bitwiseAND((1 << bits) - 1)).alias("pieces")
    columns = ["fp", "check", "size", *WORDS, *(["root"] if rooted else [])]
    kinds = F.explode(F.sequence(of(F.ceil(F.col("size") * threshold - 1e-6)), of(F.col("size")))).alias("kind")
    own = fps.withColumn("check", F.get("long", F.lit(0))).select(*columns, pieces, kinds)
    parts, low = _dealt(own, columns, bits, most, NEAR_RADIUS)

    def meet(group: pa.Table) -> pa.Table:
        group = group.drop_columns("bucket").sort_by("fp")
        fp, value, check, size, room, *words = (group[c].to_numpy() for c in ("fp", "value", "check", "size", "room", *WORDS))
        words = [w.view(np.uint64) for w in words]
        own, room = (value.view(np.uint64), check.view(np.uint64)), room.astype(np.int64)

        def may(a: np.ndarray, b: np.ndarray) -> np.ndarray:
            return may_reach(size, words, a, b, threshold)

        a, b = apart_pairs(*own, group["root"].to_numpy(), room, low, may) if rooted else local_forest(*own, room, low, may)
        return pa.Table.from_arrays([pa.array(np.minimum(fp[a], fp[b])), pa.array(np.maximum(fp[a], fp[b]))], ["a", "b"])

    return parts.groupBy("bucket").applyInArrow(meet, "a bigint, b bigint").distinct()


def _near(pairs: DataFrame, fps: DataFrame, most: int) -> DataFrame:
    """The ``pairs`` (a, b) whose long fingerprints differ in ``most`` bits at most."""
    left, right = fps.select(F.col("fp").alias("a"), F.col("long").alias("x")), fps.select(F.col("fp").alias("b"), F.col("long").alias("y"))
    apart = F.aggregate(F.zip_with("x", "y", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda n, k: n + k)
    return stored(pairs.join(left, "a").join(right, "b").where(apart <= most).select("a", "b"), "near")


def _similar(near: DataFrame, fps: DataFrame, base: DataFrame, width: int, threshold: float) -> DataFrame:
    """The pairs of ``near`` whose sets have the similarity. Sets are made of the texts in these pairs alone, one for each fingerprint."""
    own = near.select(F.col("a").alias("f")).union(near.select("b")).distinct()
    firsts = stored(fps.join(own, F.col("fp") == F.col("f"), "left_semi").select(F.col("low.uid").alias("_first")), "firsts")
    texts = base.join(_small(firsts), F.col("_uid") == F.col("_first"), "left_semi")
    sets = stored(texts.select("fp", _sets(F.col("_row.text"), width).alias("hs")), "sets")
    left, right = sets.select(F.col("fp").alias("a"), F.col("hs").alias("x")), sets.select(F.col("fp").alias("b"), F.col("hs").alias("y"))
    same = F.size(F.array_intersect("x", "y"))
    both = near.join(left, "a").join(right, "b").select("a", "b", same.alias("same"), (F.size("x") + F.size("y") - same).alias("all"))
    out = stored(both.where(F.col("same") >= threshold * F.col("all")).select("a", "b"), "linked")
    discard(near, firsts, sets)
    return out


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def near_copies(docs: DataFrame, threshold: float = 0.8, width: int = 5) -> DataFrame:
    """Groups of documents linked, directly or through others, by a Jaccard similarity of at least ``threshold`` of their
    sets of ``width``-word shingles.

    A threshold of 0.8 is about 10 of 64 bits, too far for a ball around a short fingerprint. So the SimHash is longer and
    cut into pieces (``pieces_of``), and the ball hashing that meets in the middle runs on each piece: two sets at the
    threshold are within its radius in one piece at least, but for one pair in 10,000 (sets of less than 20 shingles: one in
    100). Pairs that meet are verified by the long fingerprint and then by the exact sets. All pairs that meet count,
    however many share a variant: first each task joins what meets in it, and may be near copies by sizes and sketches of the sets, by the nearest
    pairs, a forest of them, and these are verified; then all pairs that are in different groups still meet again and are compared, so that a
    large group of near copies costs no square of its size. Two that may be near copies are in one tree of the forest, so that those in no tree
    don't meet again. Texts of one kind that are no near copies, and chance meetings, make no rows.

    ``docs`` has doc_id and text and may have any other columns. Returns the struct ``_row`` of the input's columns,
    doc_id, component_id (smallest doc_id of the group) and keep: true for one row of each group, that of the smallest
    doc_id. Null and empty texts have the same empty set. Null doc_ids come after all others. Repeated rows are
    duplicates: one is kept. An empty table gives an empty table.
    """
    bits, pieces = pieces_of(docs.count())
    base = docs.select(packed(docs), "doc_id", _signatures(F.col("text"), width, pieces // 2).alias("s"))
    numbers = [F.get("s", F.lit(k)).alias(c) for k, c in enumerate(["fp", "size", *WORDS])]
    base = base.select("_row", "doc_id", *numbers, F.slice("s", len(numbers) + 1, pieces // 2).alias("long"))
    base = stored(base.withColumn("_uid", F.monotonically_increasing_id()), "signatures")
    rank = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("_uid").alias("uid"))
    by = base.groupBy("fp").agg(F.min(rank).alias("low"), F.count("*").alias("n"), *[F.first(c).alias(c) for c in ("size", *WORDS, "long")])
    fps = stored(by, "distinct")

    some = fps.where("size IS NOT NULL")
    met = stored(_met(some, bits, threshold), "met")
    most = int(APART * 32 * pieces)
    links = _similar(_near(met, some, most), some, base, width, threshold)
    roots = stored(connected_components(links, "a", "b"), "roots")

    # what is in some tree and in different groups still meets again, and all of it that sizes and sketches don't tell apart is compared
    inside = met.select(F.col("a").alias("f")).union(met.select("b")).distinct()
    rooted = some.join(inside, F.col("fp") == F.col("f"), "left_semi").join(roots, F.col("fp") == F.col("node"), "left")
    rooted = stored(rooted.select("fp", "size", *WORDS, "long", F.coalesce("root", "fp").alias("root")), "again")
    rest = stored(_met(rooted, bits, threshold), "apart").join(met, ["a", "b"], "left_anti")
    more = _similar(_near(rest, some, most), some, base, width, threshold)
    if not more.isEmpty():
        roots = connected_components(links.unionByName(more), "a", "b")

    # rows that are alone need no group; the others find theirs
    rooted = fps.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "low", "n", F.coalesce("root", "fp").alias("root"))
    lows = rooted.groupBy(F.col("root").alias("r")).agg(F.min("low").alias("first"), F.sum("n").alias("rows")).where("rows > 1")
    groups = stored(rooted.join(lows, F.col("root") == F.col("r")).select(F.col("fp").alias("_fp"), "first"), "groups")
    joined = base.join(_small(groups), F.col("fp") == F.col("_fp"), "left")
    alone = F.col("first").isNull()
    component = F.when(alone, F.col("doc_id")).otherwise(F.col("first.id")).alias("component_id")
    return joined.select("_row", "doc_id", component, (alone | (F.col("_uid") == F.col("first.uid"))).alias("keep"))


def hexed(fp: Column) -> Column:
    """A fingerprint as 16 lower-case hex digits."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
