import itertools
import random
import tracemalloc

import corpus_pipeline
import numpy as np
from fernlog.llm import simhash
from tests_llm_brute import tokens


def firsts_of(docs, threshold=0.8, width=5):
    """Smallest id of each document's group: brute-force Jaccard of all pairs, then components."""
    sets = {}
    for i, t in docs:
        w = tokens(t)
        sets[i] = {tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))} if w else set()
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(sorted(sets), 2):
        a, b = sets[i], sets[j]
        if a == b or (a & b and len(a & b) >= threshold * len(a | b)):
            lo, hi = sorted((find(i), find(j)))
            root[hi] = lo
    return {i: find(i) for i in sets}


def planted():
    rng = random.Random(3)
    vocab = [f"v{k}" for k in range(400)]
    docs = []
    for k in range(60):
        w = [rng.choice(vocab) for _ in range(rng.choice([3, 40, 200, 400]))]
        docs.append(w)
        for edits in (0, 1, 2, 4, 8):
            copy = list(w)
            for _ in range(edits):
                copy[rng.randrange(len(copy))] = "x"
            docs.append(copy)
    return [(k, " ".join(w).title()) for k, w in enumerate(docs)] + [(900, None), (901, ""), (902, " \n")]


def test_stage_keeps_one_of_each_group(spark, sf_dir):
    docs = planted()
    want = firsts_of(docs)
    table = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3)
    got = {r.doc_id: r.component_id for r in simhash.near_copies(table).collect()}
    assert got == want
    kept = corpus_pipeline.drop_near_copies(spark, table, sf_dir).collect()
    assert sorted(r.doc_id for r in kept) == sorted(set(want.values()))


def test_documents(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    want = firsts_of([tuple(r) for r in table.collect()])
    assert {r.doc_id: r.component_id for r in simhash.near_copies(table).collect()} == want
    assert simhash.near_copies(table.limit(0)).count() == 0


def test_places_against_all_pairs():
    """The forest of a task, and the pairs of different groups, against every pair."""
    rng = np.random.default_rng(8)
    centres = rng.integers(0, 1 << 32, 12, np.uint64)
    values = np.concatenate([c ^ np.array([sum(1 << int(b) for b in rng.choice(32, k)) for k in rng.integers(0, 4, 40)], np.uint64) for c in centres])
    checks = rng.integers(0, 1 << 64, len(values), np.uint64) & np.uint64(0xFFFFFFFFFF)
    room = np.full(len(values), 2)
    near = (np.bitwise_count(values[:, None] ^ values) <= 4) & (np.bitwise_count(checks[:, None] ^ checks) <= simhash.APART_64)
    want = {(a, b) for a, b in np.argwhere(near) if a < b}
    a, b = simhash.local_forest(values, checks, room, 32)
    got = {(min(p), max(p)) for p in zip(a.tolist(), b.tolist(), strict=True)}
    group = {k: k for k in range(len(values))}

    def top(k):
        while group[k] != k:
            k = group[k]
        return k

    for x, y in got:  # no pair joins what others have joined
        assert top(x) != top(y)
        group[top(x)] = top(y)
    assert got < want and len({top(x) for x in range(len(values))}) < 40
    roots = rng.integers(0, 5, len(values))
    a, b = simhash.apart_pairs(values, checks, roots, room, 32)
    assert set(zip(a.tolist(), b.tolist(), strict=True)) == {(x, y) for x, y in want if roots[x] != roots[y]}


def hashes(n, rng):
    return np.unique(rng.integers(0, 1 << 63, n, np.uint64) * np.uint64(2) + rng.integers(0, 2, n, np.uint64))


def test_texts_of_one_kind_make_no_pairs():
    """Of many sets that meet in one variant only those that may be near copies become pairs; none at the threshold is lost."""
    rng = np.random.default_rng(5)
    for size in (9, 150, 3_000):  # the last is sketched by a sample
        base, sets = hashes(size, rng), []
        for _ in range(120):  # of one kind: similarity 0.55 or so
            sets.append(np.union1d(rng.choice(base, round(0.7 * size), replace=False), hashes(round(0.3 * size), rng)))
        for k in range(60):  # at the threshold: eight of nine hashes in common, of either size or of a part
            whole, part = hashes(size, rng), size // 9
            other = np.union1d(whole[part:], hashes(part, rng)) if k % 2 else whole[: len(whole) * 4 // 5 + 1]
            sets += [whole, other]
        n = len(sets)
        sizes, words = np.array([len(s) for s in sets]), np.array([simhash.sketch(s) for s in sets]).T.copy()
        a, b = simhash.apart_pairs(*np.zeros((2, n), np.uint64), np.arange(n), np.zeros(n, int), 32, lambda x, y: simhash.may_reach(sizes, words, x, y, 0.8))
        got = set(zip(a.tolist(), b.tolist(), strict=True))
        near = {(k, k + 1) for k in range(120, n, 2) if (m := len(np.intersect1d(sets[k], sets[k + 1]))) >= 0.8 * (sizes[k] + sizes[k + 1] - m)}
        assert len(near) >= 60 * (size > 9) and near <= got
        assert size == 9 or len(got) < 0.1 * n * (n - 1) / 2


def test_a_family_below_the_threshold(spark, monkeypatch):
    """Texts that share much and are no near copies of each other: their pairs aren't rows."""
    rng, seen, old = random.Random(6), [], simhash._near
    base = [f"w{k}" for k in range(150)]
    docs = [(k, " ".join(f"x{rng.random()}" if rng.random() < 0.04 else w for w in base)) for k in range(150)]
    docs += [(200 + k, docs[k][1] + " end") for k in range(5)]
    monkeypatch.setattr(simhash, "_near", lambda pairs, *rest: seen.append(pairs.count()) or old(pairs, *rest))
    table = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3)
    assert {r.doc_id: r.component_id for r in simhash.near_copies(table).collect()} == firsts_of(docs)
    assert seen[1] < 1_500  # all pairs are 11,935


def test_chance_meetings_make_no_rows(spark, monkeypatch):
    """What meets and is no near copy by sizes and sketches is no pair of the first look either, and doesn't meet again."""
    rng, seen, old = random.Random(7), [], simhash._near
    base = [f"w{k}" for k in range(150)]
    docs = [(k, " ".join(f"x{rng.random()}" if rng.random() < 0.06 else w for w in base)) for k in range(120)]
    monkeypatch.setattr(simhash, "_near", lambda pairs, *rest: seen.append(pairs.count()) or old(pairs, *rest))
    table = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3)
    assert {r.doc_id: r.component_id for r in simhash.near_copies(table).collect()} == firsts_of(docs)
    assert sum(seen) < 60


def test_many_buckets(spark, monkeypatch):
    """Rows dealt for a text don't grow with the buckets: 22 copies of a piece for 64 of them before."""
    assert [simhash.dealing(n, 32)[0] for n in (0, 1 << 18, 1 << 20, 1 << 21, 12_000_000)] == [1, 1, 1, 5, 5]
    monkeypatch.setattr(simhash, "BUCKET_PIECES", 4)
    docs = planted()
    table = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3)
    assert {r.doc_id: r.component_id for r in simhash.near_copies(table).collect()} == firsts_of(docs)
    pieces = spark.createDataFrame([(k, [k * 7919, k]) for k in range(200)], "fp bigint, pieces array<bigint>")
    assert simhash._dealt(pieces, ["fp"], 32, 200)[0].count() == 200 * 2 * 5


def test_pairs_in_bounded_memory():
    """Of many places in one variant only so many pairs are held at once."""
    n, rng = 3_000, np.random.default_rng(2)
    sizes, words = np.full(n, 200), rng.integers(0, 1 << 63, (simhash.SKETCH, n), np.uint64)
    args = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
    tracemalloc.start()
    a, _ = simhash.apart_pairs(*args, np.arange(n), np.zeros(n, int), 32, lambda x, y: simhash.may_reach(sizes, words, x, y, 0.8))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert not len(a) and most < 60e6


def test_large_groups(spark, sf_dir):
    """Groups in which many share a variant, with similarities on both sides of the threshold."""
    rng, docs = random.Random(4), []
    for g in range(3):
        w = [f"g{g}w{k}" for k in range(120)]
        for k in range(60):
            copy = list(w)
            for _ in range(k % 9):
                copy[rng.randrange(len(copy))] = f"x{rng.random()}"
            docs.append((len(docs), " ".join(copy)))
    table = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3)
    assert {r.doc_id: r.component_id for r in simhash.near_copies(table).collect()} == firsts_of(docs)


def test_defined_cases(spark):
    rows = [(None, None, 1, "a"), (5, "", 2, "b"), (7, "one two", 3, "c"), (7, "one two", 3, "c"), (None, "ONE\ttwo", 4, "d"), (9, "word " * 60_000, 5, "e")]
    table = spark.createDataFrame(rows, "doc_id bigint, text string, fp int, _uid string")
    got = simhash.near_copies(table).collect()
    assert sorted((r.component_id, r.keep) for r in got) == [(5, False), (5, True), (7, False), (7, False), (7, True), (9, True)]
    assert got[0]._row.__fields__ == table.columns


def test_variants_of_a_text_dont_grow_with_the_texts(spark, monkeypatch):
    """Of many buckets a text made 30,525 variants and had 75 rows; of one 7,935 and 15."""
    rng, made, old = random.Random(9), [], simhash._dealt
    docs = [(k, " ".join(f"w{rng.random()}" for _ in range(int(5 * 1.25 ** rng.uniform(0, 25))))) for k in range(400)]

    def seen(*args):
        parts, low = old(*args)
        found = [int(r.room) for r in parts.select("room").collect()]
        made.append((len(found) / 400, sum(len(simhash._masks(low, room)) for room in found) / 400))
        return parts, low

    monkeypatch.setattr(simhash, "_dealt", seen)
    table = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3)
    for most in (1 << 18, 40):  # the latter: as many buckets as millions of texts have
        monkeypatch.setattr(simhash, "BUCKET_PIECES", most)
        assert {r.component_id for r in simhash.near_copies(table).collect()} == set(range(400))
    assert made[0] == (32, 32 * 25)
    assert made[2][0] <= 64 and made[2][1] <= 64 * 25  # in two classes of sizes at most


def test_sizes_on_both_sides_of_a_class(spark, monkeypatch):
    """Sets of which one has four fifths of the other's shingles, at every size, meet wherever the classes of sizes are cut."""
    monkeypatch.setattr(simhash, "BUCKET_PIECES", 1)
    docs = []
    for k in range(5, 65):
        w = [f"t{k}w{j}" for j in range(5 * k + 4)]
        docs += [(2 * k, " ".join(w)), (2 * k + 1, " ".join(w[: 4 * k + 4]))]
    table = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3)
    want = firsts_of(docs)
    assert sum(i != first for i, first in want.items()) == 60
    assert {r.doc_id: r.component_id for r in simhash.near_copies(table).collect()} == want


def test_shingles_and_votes_against_plain_ones():
    """Equal shingles have equal hashes, others don't, also of the same words; votes are counted bit by bit."""
    texts = [list(p) for p in itertools.product("ab", repeat=5)] + [["a"], ["a", "b"], ["b", "a"], ["a", "a"], ["a"] * 4]
    found = [tuple(simhash.shingle_set(" ".join(t).encode())) for t in texts]
    assert len(set(found)) == len(texts) and all(len(f) == 1 for f in found)
    assert set(simhash.shingle_set(b"a b a b a b b")) == {f for t in ("ababa", "babab", "ababb") for f in found[texts.index(list(t))]}
    rng = np.random.default_rng(1)
    for n in (1, 2, 96, 97, 255, 256, 1_000, 3_001):
        h = rng.integers(0, 1 << 64, (n, 3), np.uint64) & rng.integers(0, 1 << 64, (n, 3), np.uint64)
        want = [int((h[:, w] >> np.uint64(63 - b) & np.uint64(1)).sum()) for w in range(3) for b in range(64)]
        assert simhash._column_sums(h).tolist() == want
