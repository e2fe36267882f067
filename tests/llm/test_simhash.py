import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import Row

from fernlog.llm import simhash


def brute(texts: dict[int, str | None], radius: int = 4) -> tuple[dict, dict]:
    """Fingerprints bit by bit and components from all pairs."""
    fps = {}
    for i, t in texts.items():
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
        for c in "\t\n\x0b\x0c\r":
            low = low.replace(c, " ")
        w = [x for x in low.split(" ") if x]
        grams = [" ".join(w[k : k + 4]) for k in range(max(1, len(w) - 3))] if w else []
        hashes = [xxhash.xxh64_intdigest(g.encode(), seed=42) for g in grams]
        fps[i] = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    comp = {i: i for i in texts}
    ids, values = sorted(texts), np.array([fps[i] for i in sorted(texts)], np.uint64)
    near = np.bitwise_count(values[:, None] ^ values[None, :]) <= radius
    changed = True
    while changed:
        changed = False
        for a in range(len(ids)):
            low = min(comp[ids[b]] for b in np.flatnonzero(near[a]))
            if low < comp[ids[a]]:
                comp[ids[a]], changed = low, True
    return fps, comp


def check(spark, texts: dict[int, str | None]):
    df = spark.createDataFrame([Row(doc_id=i, text=t) for i, t in texts.items()], "doc_id bigint, text string").repartition(3)
    got = simhash.near_duplicates(df, rows=False).collect()
    fps, comp = brute(texts)
    assert {r.doc_id: r.fp & (1 << 64) - 1 for r in got} == fps
    assert {r.doc_id: r.component_id for r in got} == comp
    assert sorted(r.doc_id for r in got if r.keep) == sorted(set(comp.values()))


def test_near_copies_against_all_pairs(spark):
    rng = random.Random(5)
    vocab = [f"w{k}é" for k in range(400)]
    texts: dict[int, str | None] = {}
    for k in range(40):
        base = [rng.choice(vocab) for _ in range(rng.choice([3, 30, 300, 2000]))]
        for _ in range(rng.choice([1, 2, 12])):
            other = list(base)
            for _ in range(rng.choice([0, 1, 3])):
                other[rng.randrange(len(other))] = rng.choice(vocab)
            texts[len(texts)] = rng.choice([" ", "\n", "\x0b \t"]).join(other).title()
    texts |= {1000: None, 1001: "", 1002: " \n\t ", 1003: "One", 1004: "ONE", 1005: "a b\u0085c d"}
    check(spark, texts)


def test_documents_against_all_pairs(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    check(spark, {r.doc_id: r.text for r in rows})


@pytest.mark.parametrize("limit", [1 << 23, 5_000])
def test_dense_cluster(monkeypatch, limit):
    """Many fingerprints around one centre: every link at 4 bits or fewer connects, also when buckets are split."""
    monkeypatch.setattr(simhash, "STEP_VARIANTS", limit)
    rng = np.random.default_rng(3)
    centre = rng.integers(0, 1 << 63, dtype=np.uint64)
    fps = [centre ^ np.uint64(sum(1 << int(b) for b in rng.choice(56, rng.integers(0, 9), replace=False))) for _ in range(150)]
    fps = np.unique(np.array(fps, np.uint64))
    root = simhash.local_roots(fps, np.full(len(fps), 2), 56, 4)
    near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 4
    want = np.arange(len(fps))
    for _ in range(len(fps)):
        want = np.array([want[near[i]].min() for i in range(len(fps))])
    same = root[:, None] == root[None, :]
    assert (same == (want[:, None] == want[None, :])).all()


def test_defined_cases(spark):
    schema = "doc_id bigint, text string, fp string, _uid int"
    df = spark.createDataFrame([(None, "a b c d e", "x", 1), (3, "a b c d e", None, 2), (3, "a b c d e", None, 2), (None, "q w e r t y", "y", 3)], schema)
    got = simhash.near_duplicates(df).collect()
    assert sum(r.keep for r in got) == 2
    assert {r.component_id for r in got if r._row.text.startswith("a")} == {3}
    assert [r.component_id for r in got if r._row.text.startswith("q")] == [None]
    assert got[0]._row.asDict().keys() == {"doc_id", "text", "fp", "_uid"}
    assert simhash.near_duplicates(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        simhash.links(df, radius=3)
