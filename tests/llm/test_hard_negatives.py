"""Hard negatives against scores of all pairs."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from fernlog.llm import hard_negatives as H

SCHEMA = "vec_id bigint, embedding array<double>, label int, score string, uid int"


def plain(rows, is_anchor, positives=5, negatives=5, low=80, high=100):
    own = [(i, [math.floor(256 * x) for x in e], lab, n) for n, (i, e, lab, *_) in enumerate(rows) if i is not None and e is not None and lab is not None and all(x is not None and math.isfinite(x) for x in e)]
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=False))
    out = []
    for i, e, lab, n in own:
        if not is_anchor(i):
            continue
        near = sorted((-dot(e, o), j, m) for j, o, x, m in own if x == lab and m != n)[:positives]
        far = sorted((-dot(e, o), j) for j, o, x, _ in own if x != lab)
        for s, p, _ in near:
            fit = [(j, -t) for t, j in far if low * -s <= 100 * -t <= high * -s][:negatives]
            out += [(i, p, r, j, -s, t) for r, (j, t) in enumerate(fit, 1)]
    return sorted(out)


def table(seed, n, dim, labels):
    rng = random.Random(seed)
    rows = [(k, [rng.gauss(0.2, 0.3) for _ in range(dim)], rng.randrange(labels), "x", 0) for k in range(n)]
    common = [0.5] * dim
    rows += [(n + k, common, k % 3, "x", 0) for k in range(60)]
    rows += [(None, common, 1, "x", 0), (1, None, 1, "x", 0), (2, common, None, "x", 0), (3, [0.1, None], 1, "x", 0), (4, [float("nan")] * dim, 1, "x", 0), (5, [float("inf")] * dim, 1, "x", 0)]
    rows += [(6, [], 1, "x", 0), (7, [0.9], 1, "x", 0), (8, [-0.4] * dim, 2, "x", 0), (10, rows[10][1], rows[10][2], "x", 0), (10, rows[10][1], rows[10][2], "x", 0), (n + 100, common, 77, "x", 0)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize(("seed", "n", "dim", "labels"), [(1, 600, 16, 4), (2, 300, 7, 2), (3, 150, 1, 3)])
def test_equals_all_pairs(spark, seed, n, dim, labels):
    rows = table(seed, n, dim, labels)
    got = H.mine(spark.createDataFrame(rows, SCHEMA).repartition(3), F.col("vec_id") % 10 == 0)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    want = plain(rows, lambda i: i % 10 == 0)
    assert len(want) > 100 and sorted(map(tuple, got.collect())) == want


def test_other_numbers_and_slices(spark, monkeypatch):
    monkeypatch.setattr(H, "SLICE", 7)
    monkeypatch.setattr(H, "SAMPLE", 40)
    rows = table(4, 200, 5, 3)
    got = H.mine(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 10 == 0, positives=2, negatives=30, low=10, high=150)
    assert sorted(map(tuple, got.collect())) == plain(rows, lambda i: i % 10 == 0, 2, 30, 10, 150)


def test_nothing_to_mine(spark):
    rows = table(5, 30, 4, 3)
    df = spark.createDataFrame(rows, SCHEMA)
    assert H.mine(df.limit(0), F.lit(True)).count() == 0
    assert H.mine(df, F.lit(False)).count() == 0
    assert H.mine(df.where("label = 2"), F.lit(True)).count() == 0
    assert H.mine(df.where("vec_id = 6"), F.lit(True)).count() == 0


def test_components_that_leave_the_range(spark):
    df = spark.createDataFrame([(0, [1e300], 1), (1, [1.0], 2)], "vec_id bigint, embedding array<double>, label int")
    with pytest.raises(Exception, match=r"don't fit|OVERFLOW|overflow"):
        H.mine(df, F.lit(True)).collect()


def test_bounds_hold_and_spare_most_scores():
    rng = np.random.default_rng(6)
    x = np.floor(256 * rng.normal(0, 0.125, (20_000, 64))).astype(np.int64)
    cells = H.Cells(x[:2_000], x.min(axis=0), x.max(axis=0))
    least, most = (H._bound(t, cells.of(x)) for t in cells.tables(x[:8]))
    exact = x[:8] @ x.T
    assert (least <= exact).all() and (exact <= most).all()
    top = np.sort(exact, axis=1)[:, -6]
    assert (most >= top[:, None]).mean() < 0.02
    # values outside the sample's range
    far = np.vstack([x.min(axis=0), x.max(axis=0)])
    least, most = (H._bound(t, cells.of(far)) for t in cells.tables(-x[:3]))
    assert (least <= -x[:3] @ far.T).all() and (-x[:3] @ far.T <= most).all()
