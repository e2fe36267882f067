"""Reply trees and their formatted conversations against plain walks, and the template's exact way back."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from fernlog.llm import chat

TREES = "tree bigint, id bigint, parent_id bigint, role string, text string, score double"
ODD = ["", "\\", "\\\\", "##", "###", "####", "# # #", "</turn>", "</turn>\n", "<\\/turn>", "\\</turn>", "#\\#", "### user\nhi</turn>\n", "\\### Assistant: </turn> ok", "a\nb\r\n", "é😀\u2028", "</tu</turn>rn>", "\\n$1", None]


def plain_paths(rows, branches=None):
    """(tree, leaf, rank, score, ids from the root)"""
    at = {r[1]: r for r in rows if r[1] is not None}
    parents = {r[2] for r in at.values() if r[2] in at}
    out = {}
    for i in at.keys() - parents:
        walk, seen = [i], {i}
        while (up := at[walk[-1]][2]) in at and up not in seen:
            walk.append(up)
            seen.add(up)
        if up in seen:
            continue
        score = sum(at[x][5] or 0.0 for x in walk) / len(walk)
        out.setdefault(at[i][0], []).append((-score, i, walk[::-1]))
    return sorted((t, i, k, round(-s, 9), w) for t, found in out.items() for k, (s, i, w) in enumerate(sorted(found), 1) if branches is None or k <= branches)


def forest(seed, n=250):
    rng = random.Random(seed)
    rows = []
    for k in range(n):
        tree = rng.choice([1, 1, 1, 2, 3])
        earlier = [r[1] for r in rows if r[0] == tree]
        parent = rng.choice(earlier[-6:]) if earlier and rng.random() < 0.95 else rng.choice([None, 9_999])
        rows.append((tree, k, parent, rng.choice(["user", "assistant", "system", None, "a\nb", "## x"]), rng.choice(ODD) if rng.random() < 0.5 else f"text {k}", rng.choice([0.5, 1.0, None, 0.25])))
    rows += [(4, 1000, 1001, "user", "in a circle", 1.0), (4, 1001, 1000, "user", "in a circle", 1.0), (4, 1002, 1001, "user", "below it", 1.0), (4, 1003, 1003, "user", "alone", 1.0), (5, None, 1, "user", "no id", 1.0)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("branches", [None, 2])
def test_paths_of_trees(spark, branches):
    rows = forest(3)
    df = spark.createDataFrame(rows, TREES).withColumns({"path": F.lit(1), "depth": F.lit("x")})
    got = {}
    for r in chat.paths(df.repartition(3), branches).collect():
        got.setdefault((r.tree, r.path, r["rank"], round(r.score, 9), r.turns), {})[r.depth] = r.node
    assert sorted((t, p, k, s, [w[d] for d in range(n)]) for (t, p, k, s, n), w in got.items()) == plain_paths(rows, branches)
    assert chat.paths(df.limit(0), branches).count() == 0


def test_conversations_of_trees(spark):
    rows = forest(8, 120)
    at = {r[1]: r for r in rows}
    got = {r["path"]: r for r in chat.digests(chat.format_trees(spark.createDataFrame(rows, TREES))).collect()}
    want = plain_paths(rows)
    assert got.keys() == {i for _, i, *_ in want}
    for _, leaf, rank, _, walk in want:
        r, said = got[leaf], [(at[i][3] or "", at[i][4] or "") for i in walk]
        assert (r["rank"], r.turns, r.n_turns) == (rank, len(walk), len(walk))
        assert "".join(s.text for s in r.segments) == r.formatted and r.formatted_chars == len(r.formatted)
        assert r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in said).encode()).hexdigest()
        learned = "".join(b for a, b in said if a == "assistant")
        assert (r.loss_chars, r.loss_sha256) == (len(learned), hashlib.sha256(learned.encode()).hexdigest())
        # no text can pretend to be the template's
        assert r.formatted.count("</turn>") == len(walk) and r.formatted.count("###") == len(walk)


def test_escapes_come_back(spark):
    rng = random.Random(5)
    texts = ODD + ["".join(rng.choices(["#", "\\", "<", "/", "</turn>", "a", "\n", "turn>"], k=rng.randint(0, 12))) for _ in range(3000)]
    df = spark.createDataFrame([(t,) for t in texts], "text string").withColumn("said", chat.escape(F.col("text")))
    rows = df.select("text", "said", chat.unescape(F.col("said")).alias("back")).collect()
    assert all(r.back == (r.text or "") and "</turn>" not in r.said and "###" not in r.said for r in rows)


def test_threads_of_conversations(spark):
    rows = [(1, 2, "user", "b", 0), (1, 1, "user", "a", 0), (1, 7, "assistant", None, 0), (1, None, "user", "last", 0), (1, 7, "assistant", None, 0), (1, 7, None, "x", 0), (None, 1, "user", "none", 0), (None, 2, "assistant", "none", 0), (3, 0, "system", "", 0)]
    rows += [(8, k, ("user", "assistant")[k % 2], f"turn {k} \\ ##", 0) for k in range(1500)]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string, score int").repartition(4)
    got = {r.tree: r for r in chat.digests(chat.format_trees(chat.threads(df))).collect()}
    last = lambda x: (x is None, x)
    for conv in (1, None, 3, 8):
        said = [(r or "", t or "") for _, r, t in sorted(((t, r, x) for c, t, r, x, _ in rows if c == conv), key=lambda r: tuple(map(last, r)))]
        assert got[conv].turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in said).encode()).hexdigest() and got[conv].n_turns == len(said)
        assert got[conv].loss_chars == sum(len(b) for a, b in said if a == "assistant")
    assert len(got) == 4 and chat.format_trees(chat.threads(df.limit(0))).count() == 0


def test_a_very_long_text(spark):
    text = "##</turn>\\é" * 60_000
    df = spark.createDataFrame([(1, 0, "user", text), (1, 1, "assistant", text)], "conv_id bigint, turn bigint, role string, text string")
    r = chat.digests(chat.format_trees(chat.threads(df))).first()
    assert r.loss_chars == len(text) and r.loss_sha256 == hashlib.sha256(text.encode()).hexdigest()
