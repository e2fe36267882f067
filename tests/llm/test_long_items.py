import random

from pyspark.sql import functions as F

from fernlog.llm import decontam
from test_decontam import compare


def test_long_items_count_whole(spark):
    """A tail, or half, of a long item is no leak; nearly all of it is."""
    rng = random.Random(2)
    vocab = [f"v{k}" for k in range(5_000)]
    text = lambda n: [rng.choice(vocab) for _ in range(n)]
    a, b = text(517), text(1_024)
    edited = list(b)
    for k in range(100, 1_000, 100):
        edited[k] = "x"
    docs = [(1, text(40) + a[-5:] + text(40)), (2, text(9) + b[:512] + text(600)), (3, text(30) + a + text(5)), (4, text(8) + edited + text(300)), (5, b[20:])]
    want = compare(spark, [(k, " ".join(w)) for k, w in docs], [(1, " ".join(a)), (2, " ".join(b))])
    assert want.keys() == {(3, 1), (4, 2), (5, 2)}


def test_fingerprints_from_pieces(spark):
    """Windows with more hashes than the lanes hold have the fingerprint that one sum would give."""
    rows = spark.range(3).select("id", F.transform(F.sequence(F.lit(0), F.lit(299)), lambda k: F.xxhash64(k, "id")).alias("hs"))
    got = [sorted(map(tuple, decontam._simhash(rows, ["id"], 300, piece).collect())) for piece in (300, 64)]
    assert got[0] == got[1]
