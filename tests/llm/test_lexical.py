"""Ranked search against plain scoring of every document."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from fernlog.llm import lexical

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def plain(docs, items, k=10):
    own = [(d, Counter(terms(t))) for d, t in docs]
    full = [(d, c, c.total()) for d, c in own if c]
    n_docs, n_terms = len(full), sum(n for *_, n in full)
    df = Counter(t for _, c, _ in full for t in c)
    out = []
    for i, text in items:
        scored = []
        for d, c, n in full:
            m = 10 + 90 * n * n_docs // n_terms
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m)) for t in set(terms(text)) & c.keys())
            if s > 0:
                scored.append((-s, d is None, d or 0, d))
        out += [(i, r, d, -s) for r, (s, _, _, d) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=repr)


def corpus(seed, n=900):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(200)] + ["Straße", "été", "日本語", "İx", "A1"]
    weight = [1 / (k + 1) for k in range(len(vocabulary))]
    docs = [(k, " ".join(rng.choices(vocabulary, weight, k=rng.choice([1, 3, 30, 200])))) for k in range(n)]
    docs += [(n, None), (n + 1, ""), (n + 2, " .,-\t"), (None, "w1 w2 été"), (None, "w1 w2 été"), (7, "w1 w2 été"), (7, "w1 w2 été"), (n + 3, "W1\x00w2_w3~w150 " * 4000), (n + 4, "x" * 300_000 + " w199")]
    rng.shuffle(docs)
    items = [(k, " ".join(rng.choices(vocabulary, k=rng.choice([1, 4, 40])))) for k in range(25)] + [(90, None), (91, "..."), (92, "nowhere"), (93, "w1 w2 w1"), (93, "w3"), (None, "W199 été")]
    return docs, items


@pytest.mark.parametrize(("seed", "block", "short", "segment"), [(1, 128, 8, 16_384), (2, 8, 2, 200), (3, 4, 0, 97)])
def test_equals_scoring_everything(spark, monkeypatch, seed, block, short, segment):
    for name, value in (("BLOCK", block), ("SHORT", short), ("SEGMENT", segment), ("CUT", 64)):
        monkeypatch.setattr(lexical, name, value)
    docs, items = corpus(seed)
    # walked here with the blocks of the case; Spark's workers hold the defaults
    own, n_docs, n_terms, df = [], 0, 0, Counter()
    for lo in range(0, len(docs), segment):
        s = lexical._Segment(lo)
        for d, t in docs[lo : lo + segment]:
            found = Counter(x for some in lexical.terms_of((t or "").encode()) for x in some)
            s.add(d, found, found.total(), None)
            n_docs, n_terms = n_docs + bool(found), n_terms + found.total()
            df.update(found.keys())
        own += s.rows()
    weights = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * f + 1))) for t, f in df.items()}
    got = {}
    for b in lexical._searched(iter(own), [lexical.item_terms(t) for _, t in items], weights, n_docs, n_terms, 10):
        for r in b.to_pylist():
            got.setdefault(r["item"], []).append((r["doc_id"], r["score"]))
    assert sorted(((items[i][0], k, d, s) for i, rows in got.items() for k, (d, s) in enumerate(rows, 1)), key=repr) == plain(docs, items)


def test_whole_search(spark):
    docs, items = corpus(5)
    d = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], "doc_id bigint, text string, term string, segment int").repartition(3)
    q = spark.createDataFrame([(i, t, 9) for i, t in items], "item_id int, text string, doc_id int")
    got = lexical.rank_documents(d, q)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, got.collect()), key=repr) == plain(docs, items)
    assert lexical.rank_documents(d, q.limit(0)).count() == 0
    assert lexical.rank_documents(d.limit(0), q).count() == 0


def test_items_in_slices_and_an_index_of_all_terms(spark, monkeypatch):
    docs, items = corpus(6, 200)
    monkeypatch.setattr(lexical, "MOST_PAIRS", 20)
    monkeypatch.setattr(lexical, "MOST_TERMS", 3)
    d, q = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id int, text string")
    assert sorted(map(tuple, lexical.rank_documents(d, q).collect()), key=repr) == plain(docs, items)


def test_an_index_grows_by_segments(spark):
    """Blocks hold competitive pairs, not impacts: what is indexed later changes the statistics but no block."""
    docs, items = corpus(8, 300)
    half = [spark.createDataFrame(docs[k::2], "doc_id bigint, text string").coalesce(1) for k in (0, 1)]
    a, b = (lexical.stored(lexical.build_index(x), "half") for x in half)
    both = a.unionByName(b.withColumn("segment", b["segment"] + (1 << 60)))
    assert sorted(map(tuple, lexical.search(both, items).collect()), key=repr) == plain(docs, items)


def test_blocks_below_the_threshold_stay_packed():
    """A document of all the rare terms leaves the blocks of the frequent ones unread."""
    rng = random.Random(4)
    s = lexical._Segment(0)
    for k in range(12_000):
        found = Counter({b"common": rng.randint(1, 3), b"often": 1} if k % 2 else {b"common": 1})
        if k in range(6_000, 6_010):
            found.update([b"rare", b"rarer"])
        s.add(k, found, found.total() + rng.randint(5, 50), None)
    rows = {}
    for b in s.rows():
        for r in b.to_pylist():
            if r["term"] is None:
                own = r
            else:
                rows.setdefault(r["term"], []).append(tuple(r[c] for c in lexical._HEAD))
    n, total = own["docs"], own["tokens"]
    spread_of = lambda x: 10 + 90 * x * n // total
    spread = spread_of(np.array(own["lengths"]))
    lists = {t: lexical.Postings(r, {b"common": 1, b"often": 700}.get(t, 7_000), spread, spread_of) for t, r in rows.items()}
    best = lexical.Best(5)
    lexical.walk(list(lists.values()), np.arange(12_000), np.zeros(12_000, bool), best)
    assert len(best.ids) == 5 and set(best.ids) <= set(range(6_000, 6_010))
    read = {t: sum(x is not None for x in p.read) for t, p in lists.items()}
    assert read[b"common"] <= 2 and read[b"often"] <= 2 and len(lists[b"common"].read) == 94


def test_packing_comes_back():
    rng = np.random.default_rng(1)
    for top in (1, 2, 3, 1000, 1 << 20):
        x = rng.integers(0, top, 77)
        assert (lexical._unpack(lexical._pack(x), 77) == x).all()
