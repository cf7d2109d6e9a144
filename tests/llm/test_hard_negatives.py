"""Hard negatives: against all scores computed in plain integers."""

import math
import random

import numpy as np
import pytest

from pairloom.llm import op11_hard_negatives as op


def brute(rows, k=5):
    ok = [r for r in rows if r[0] is not None and r[1] is not None and r[2] is not None]
    ok = [r for r in ok if all(x is not None and math.isfinite(x) for x in r[2])]
    ok = [(i, (c + 1) % 10 if i % 7 == 0 else c, [math.floor(256 * x) for x in v]) for i, c, v in ok]
    out = []
    for a, label, v in ok:
        if a % 100:
            continue
        scored = [(-sum(x * y for x, y in zip(v, w)), i, c) for i, c, w in ok if i != a and len(w) == len(v)]
        scored.sort()
        for s, p, _ in [r for r in scored if r[2] == label][:k]:
            fits = [(n, t) for t, n, c in scored if c != label and 80 * -s <= 100 * -t <= 100 * -s][:k]
            out += [(a, p, rank, n, -s, -t) for rank, (n, t) in enumerate(fits, 1)]
    return sorted(out)


SCHEMA = "vec_id long, embedding array<float>, label int"


def check(df):
    rows = [(r.vec_id, r.label, r.embedding) for r in df.select("vec_id", "label", "embedding").collect()]
    got = sorted(map(tuple, op.hard_negatives(df).collect()))
    assert got == brute(rows)
    return got


def clustered(seed, n, dim=16, clusters=4):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(clusters, dim))
    v = (centres[rng.integers(0, clusters, n)] + 0.3 * rng.normal(size=(n, dim))).astype(np.float32)
    labels = rng.integers(0, 10, n)
    return [(int(i), [float(x) for x in v[k]], int(labels[k])) for k, i in enumerate(rng.permutation(n) * 5)]


@pytest.mark.parametrize("tile, anchors", [(op.LEAST_TILE, op.ANCHORS), (64, 3)])
def test_against_brute_force(spark, monkeypatch, tile, anchors):
    monkeypatch.setattr(op, "LEAST_TILE", tile)
    monkeypatch.setattr(op, "MOST_TILE", tile)
    monkeypatch.setattr(op, "ANCHORS", anchors)
    got = check(spark.createDataFrame(clustered(1, 900), SCHEMA).repartition(5))
    assert len(got) > 200


def test_whole_table(spark):
    check(spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet"))


def test_odd_rows(spark):
    rng = random.Random(4)
    rows = clustered(2, 300, dim=6)
    rows += [(100, None, 1), (200, [1.0] * 6, None), (None, [1.0] * 6, 2), (300, [1.0, None] * 3, 3), (400, [math.nan] * 6, 1)]
    rows += [(500, [math.inf] * 6, 1), (700, [], 1), (701, [], 1), (702, [], 2), (600, [1.0] * 3, 4), (601, [0.9] * 3, 4), (602, [0.8] * 3, 5)]
    rows += [(k, [0.5] * 6, k % 3) for k in range(5000, 5300)]  # a third of all rows are ties
    rows += rows[:5] + [(5000, [0.5] * 6, 2)] * 2 + [(k, [0.0] * 6, 9) for k in (9000, 9001, 9002, 9100)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'x' AS id", "1 AS score", "2 AS row", "3 AS cell")
    got = check(df.repartition(3))
    assert {700, 600, 5000, 9000} <= {r[0] for r in got}


def test_empty_and_without_anchors(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert op.hard_negatives(empty).columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert op.hard_negatives(empty).count() == 0
    assert check(spark.createDataFrame([(1, [1.0], 1), (2, [1.0], 2)], SCHEMA)) == []
    assert check(spark.createDataFrame([(100, [1.0], 1), (2, [1.0], 2)], SCHEMA)) == []
    df = spark.createDataFrame([(100, [1e30, 1.0], 1), (101, [2.0, 1.0], 1), (102, [1.7, 1.0], 2)], SCHEMA)
    assert op.hard_negatives(df).count() == 1


def test_bounds_shrink_the_candidates():
    rng = np.random.default_rng(3)
    vectors = rng.integers(-60, 60, (4000, 64))
    vectors[:40] = 100 * np.sign(vectors[7]) + rng.integers(-9, 9, (40, 64))
    block = op.Block(np.arange(4000), np.zeros(4000, np.int64), vectors)
    anchor, best, seen = np.sort(np.abs(vectors[7]))[::-1] * np.sign(vectors[7]), op.Best(5), []

    def keep(lower, upper):
        seen.append(len(lower))
        return upper >= op.kth(lower, 5)

    rows, scores = block.scan(anchor, np.arange(4000), keep)
    best.add(scores, block.ids[rows])
    want = sorted(zip(-(vectors @ anchor), range(4000)))[:5]
    assert [(-s, i) for s, i in zip(best.scores, best.ids)] == want
    assert seen[0] == 4000 and seen == sorted(seen, reverse=True) and seen[-1] < 100
