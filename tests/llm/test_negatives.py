"""Hard-negative mining against a plain loop over all pairs."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import functions as F

from textlake.llm import negatives

SCHEMA = "vec_id bigint, label int, embedding array<double>, score int, slot string"


def table(spark, rows):
    return spark.createDataFrame([(i, y, v, 1, "s") for i, y, v in rows], SCHEMA)


def plain(rows, asks, positives=5, k=10, scale=256, least=(30, 100), most=(90, 100)):
    sound = [(i, y, [math.floor(scale * x) for x in v]) for i, y, v in rows
             if i is not None and y is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for i in sorted({i for i, _, _ in sound if asks(i)}):
        _, label, mine = min((i, y, v) for j, y, v in sound if j == i)
        scores = sorted((-sum(a * b for a, b in zip(mine, v, strict=True)), j, y == label)
                        for j, y, v in sound if len(v) == len(mine) and (j != i or y != label))
        for p, pid, _ in [s for s in scores if s[2] and s[1] != i][:positives]:
            inside = [(s, j) for s, j, same in scores
                      if not same and least[0] * -p <= least[1] * -s and most[1] * -s <= most[0] * -p]
            out += [(i, pid, n + 1, j, -p, -s) for n, (s, j) in enumerate(inside[:k])]
    return sorted(out)


def mined(df):
    return sorted(tuple(r) for r in df.collect())


def test_against_a_plain_loop(spark):
    rng = np.random.default_rng(5)
    # few different values: many equal scores, limits that coincide, scores below zero
    rows = [(i, int(rng.integers(0, 4)), (rng.integers(-2, 4, 6) / 4).tolist()) for i in range(400)]
    want = plain(rows, lambda i: i % 9 == 0)
    assert len(want) > 500
    assert mined(negatives.mine_negatives(table(spark, rows), F.col("vec_id") % 9 == 0)) == want
    # several blocks, other numbers
    got = negatives.mine_negatives(table(spark, rows).repartition(7), F.col("vec_id") % 9 == 0, positives=2, k=3,
                                   least=(1, 2), most=(1, 1), block_anchors=7)
    assert mined(got) == plain(rows, lambda i: i % 9 == 0, 2, 3, least=(1, 2), most=(1, 1))


def test_awkward_rows(spark):
    rows = [
        (0, 1, [1.0, 0.5]), (1, 1, [1.0, 0.25]), (2, 2, [0.5, 0.5]), (3, 2, [0.5, 0.5]), (4, None, [1.0, 1.0]),
        (5, 2, None), (6, 2, [0.5, None]), (7, 2, [float("nan"), 0.5]), (8, 2, [float("inf"), 0.5]),
        (None, 2, [0.5, 0.5]), (9, 2, [0.5, 0.5, 0.5]), (10, 1, [0.9, 0.1, 0.0]), (11, 3, []), (12, 3, []),
        (2, 2, [0.5, 0.5]), (20, 5, [3e38, 1.0]), (21, 5, [2.9e38, 0.0]), (22, 6, [1.0, 0.0]),
    ]
    got = mined(negatives.mine_negatives(table(spark, rows), F.col("vec_id") < 20))
    assert got == plain(rows, lambda i: i < 20)
    assert (0, 1, 2, 2, 256 * 256 + 128 * 64, 128 * 256 + 128 * 128) in got
    huge = mined(negatives.mine_negatives(table(spark, rows[-3:]), F.lit(True), least=(0, 1), most=(1, 1)))
    assert {r[0] for r in huge} == {20, 21} and {r[3] for r in huge} == {22}
    assert all(r[4] == 2 ** 62 for r in huge)


def test_no_rows_and_no_anchors(spark):
    none = negatives.mine_negatives(table(spark, [(1, 1, [1.0])]).limit(0), F.lit(True))
    assert none.collect() == [] and none.columns == [
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert negatives.mine_negatives(table(spark, [(1, 1, [1.0]), (2, 1, [1.0])]), F.lit(False)).collect() == []
    assert negatives.mine_negatives(table(spark, [(1, 1, [1.0])]), F.lit(True)).collect() == []


def test_a_task_hands_on_bounded_rows(spark):
    rng = np.random.default_rng(6)
    rows = [(i, i % 2, rng.normal(size=4).tolist()) for i in range(3000)]
    ids = negatives.Best(3, 4)
    ids.add(np.zeros(500, np.int64), np.repeat(np.arange(5), 100), np.arange(500)[::-1].copy())
    assert ids.score.tolist() == [4] * 4 and ids.id.tolist() == [0, 1, 2, 3]
    assert mined(negatives.mine_negatives(table(spark, rows), F.col("vec_id") % 500 == 0)) == plain(rows, lambda i: i % 500 == 0)


def test_exact_beyond_doubles():
    rows = np.array([[2 ** 40 + 1, 3], [-(2 ** 50), 2 ** 50]])
    anchors = np.array([[2 ** 18 + 1, 1], [5, 7]])
    want = [[sum(int(x) * int(y) for x, y in zip(r, a, strict=True)) for a in anchors] for r in rows]
    assert negatives.products(rows, anchors).tolist() == [[max(-2 ** 62, min(2 ** 62, x)) for x in r] for r in want]
