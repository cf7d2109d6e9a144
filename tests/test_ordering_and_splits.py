import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairloom.operators import ordering as O
from pairloom.operators import simjoin as S
from pairloom.operators import splits as X


def test_ordered_index_in_a_hot_group(spark):
    df = spark.range(500).select(
        F.when(F.col("id") % 3 == 0, None).when(F.col("id") % 3 == 1, "hot").otherwise(F.concat(F.lit("g"), F.col("id") % 7)).alias("g"),
        ((F.col("id") * 7919) % 500).alias("v"),
    )
    rows = O.ordered_index(df, [F.col("v")], ["g"]).collect()
    groups = {}
    for r in rows:
        groups.setdefault(r.g, []).append((r.idx, r.v, r.idx_n))
    assert sum(map(len, groups.values())) == 500
    for g in groups.values():
        g.sort()
        assert [i for i, _, _ in g] == list(range(len(g)))
        assert [v for _, v, _ in g] == sorted(v for _, v, _ in g)
        assert {n for _, _, n in g} == {len(g)}


def test_hash_rank_is_a_stable_permutation(spark):
    df = spark.range(300)
    a = {r.id: r.rnd for r in O.hash_rank(df, 1, F.col("id")).collect()}
    b = {r.id: r.rnd for r in O.hash_rank(df.repartition(5), 1, F.col("id")).collect()}
    c = {r.id: r.rnd for r in O.hash_rank(df, 2, F.col("id")).collect()}
    assert sorted(a.values()) == list(range(300)) and a == b and a != c
    grouped = O.hash_rank(df.withColumn("g", F.when(F.col("id") % 3 > 0, F.col("id") % 3)), 1, F.col("id"), ["g"]).collect()
    for g in (None, 1, 2):
        assert sorted(r.rnd for r in grouped if r.g == g) == list(range(100))


@pytest.mark.parametrize("values", [[1.0], [2.0, 2.0, 2.0], [1, 2, 3, 4], [0.5, 9, 9, 9, 1, 1, 4], []])
def test_exact_quantiles(spark, values):
    df = spark.createDataFrame([(float(v),) for v in values] + [(None,), (float("nan"),)], "v double")
    rows = O.exact_quantiles(df, "v", {"q1": 0.25, "q2": 0.5, "q3": 0.75}).collect()
    if not values:
        assert rows[0].q1 is None
        return
    assert [rows[0].q1, rows[0].q2, rows[0].q3] == pytest.approx(list(np.percentile(values, [25, 50, 75])))


def greedy(groups, n, train, valid):
    out, a, b = {}, 0, 0
    for name, (size, first) in sorted(groups.items(), key=lambda x: x[1], reverse=True):
        if a + size > train * n:
            if a + b + size > (train + valid) * n:
                out[name] = "test"
            else:
                out[name], b = "valid", b + size
        else:
            out[name], a = "train", a + size
    return out


@pytest.mark.parametrize("shape", ["mixed", "ones", "huge"])
def test_group_greedy_equals_the_sequential_fill(spark, shape):
    r = random.Random(4)
    pick = {"mixed": lambda i: f"g{int(r.random() ** 2 * 40)}", "ones": lambda i: f"g{i}", "huge": lambda i: "big" if i % 10 else f"s{i}"}[shape]
    rows = [(i, pick(i) if i % 17 else None) for i in range(200)]
    df = spark.createDataFrame(rows, "id long, grp string")
    got = {x.id: x.split for x in X.group_greedy_split(df, [], "grp", "id").collect()}
    groups = {}
    for i, g in rows:
        if g is not None:
            size, first = groups.get(g, (0, i))
            groups[g] = (size + 1, min(first, i))
    want = greedy(groups, 200, 0.8, 0.1)
    assert got == {i: want[g] for i, g in rows if g is not None}


def test_endpoint_split_tops_up_small_tests(spark):
    rows = [(i, "ds", "big", "x", f"g{i % 3}") for i in range(60)] + [(100 + i, "ds", "small", "x", "g") for i in range(5)]
    rows += [(200, "ds", "empty", " ", "g")]
    df = spark.createDataFrame(rows, "id long, dataset_name string, endpoint string, text string, grp string")
    s = X.endpoint_split(df, ["dataset_name", "endpoint"], "text", "grp", "id", 5, 7)
    got = {(r.endpoint, r.split_type, r.split): r["count"] for r in s.groupBy("endpoint", "split_type", "split").count().collect()}
    assert got == {("big", "train_test", "test"): 7, ("big", "train_test", "train"): 53, ("small", "unseen_endpoint_test", "test"): 5}
    summary = {r.endpoint: r.split_type for r in X.endpoint_split_summary(df, s, ["dataset_name", "endpoint"], "text").collect()}
    assert summary["empty"] == "skip"


def test_sphere_clusters_equal_the_sequential_sweep(spark):
    r = random.Random(8)
    rows = [(i, "e", [str(x) for x in r.sample(range(12), 5)]) for i in range(70)]
    df = spark.createDataFrame(rows, "id long, ep string, bits array<string>")
    sets = S.distinct_sets(df, ["ep"], "id", "bits")
    members = S.set_members(df, sets, ["ep"], "id", "bits").drop("ep")
    last = members.groupBy("first_id").agg(F.max("id").alias("last_id"))
    pairs = S.similar_sets_within(sets, ["ep"], 4, 10)
    clusters = X.sphere_clusters(sets.join(last, "first_id"), pairs)
    got = {x.id: x.centre_id for x in members.join(clusters, "first_id").collect()}
    bits = {i: set(b) for i, _, b in rows}
    near = {i: {j for j in bits if j != i and len(bits[i] & bits[j]) * 10 >= 4 * len(bits[i] | bits[j])} for i in bits}
    want, seen = {}, set()
    for i in sorted(bits, key=lambda k: (len(near[k]), k), reverse=True):
        if i in seen:
            continue
        for j in {i} | (near[i] - seen):
            want[j] = i
            seen.add(j)
    assert got == want


def test_splits_cover_and_do_not_straddle_groups(spark):
    df = spark.range(200).withColumn("g", F.col("id") % 13).withColumn("y", F.col("id") % 5)
    for out in (
        X.random_split(df, "id"),
        X.random_group_split(df, "g"),
        X.stratified_split(df, "id", ["y"]),
        X.order_split(df, ["y", "id"]),
        X.gap_fill_split(df, "g", "id"),
    ):
        assert out.count() == 200 and out.select("id").distinct().count() == 200
    for out in (X.random_group_split(df, "g"), X.gap_fill_split(df, "g", "id"), X.group_greedy_split(df, [], "g", "id")):
        assert out.groupBy("g").agg(F.countDistinct("split").alias("n")).filter("n > 1").count() == 0
    tail = spark.range(23).withColumn("y", F.col("id"))
    assert X.ordered_label_split(tail, "id", "y").count() == 20
    assert X.ordered_label_split(tail, "id", "y", tail="train").count() == 23


def test_gap_runs_equal_single_picks():
    import random

    rng = random.Random(3)
    for _ in range(200):
        sizes = sorted({rng.randint(1, 40): rng.randint(1, 60) for _ in range(rng.randint(1, 8))}.items(), reverse=True)
        n = sum(s * c for s, c in sizes)
        gaps = [0.8 * n, 0.1 * n, 0.1 * n]
        runs = X.gap_runs(sizes, gaps)
        for size, count in sizes:
            own = [(a, t) for s, a, t in runs if s == size]
            for r in range(count):
                a, takers = [x for x in own if x[0] <= r][-1]
                want = max(range(3), key=lambda i: gaps[i])
                assert takers[(r - a) % len(takers)] == want
                gaps[want] -= size
    assert len(X.gap_runs([(1, 10**9)], [8e8, 1e8, 1e8])) < 6


def test_ordered_label_keeps_whole_blocks_only(spark):
    d = spark.range(27).selectExpr("id", "id * 2 AS y")
    assert X.ordered_label_split(d, "id", "y", seed=7).count() == 20


def test_hash_rank_is_the_same_for_any_number_of_buckets(spark):
    from pairloom.operators.ordering import hash_rank

    d = spark.range(3000).selectExpr("id", "id % 3 AS g")
    few = {r.id: r.rnd for r in hash_rank(d, 1, F.col("id"), ["g"]).collect()}
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "1100")
        many = hash_rank(d, 1, F.col("id"), ["g"])
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert {r.id: r.rnd for r in many.collect()} == few


def test_neighbour_records_and_fallback(spark):
    from pairloom.operators import knn

    q = spark.createDataFrame([(1, "a", ["x", "y"]), (2, "b", None)], "q_id long, q_anchor string, q_bits array<string>")
    p = spark.createDataFrame([(10, "c", ["x", "y"]), (11, "d", ["x", "y"])], "p_id long, p_anchor string, p_bits array<string>")
    rows = {r.q_id: r for r in knn.nearest_records(q, p, 1).collect()}
    assert rows[1].p_id == 10 and rows[1].error is None and rows[2].p_id is None and rows[2].error == "no features"
    got = knn.nearest_or_any(q.filter("q_id = 1"), p, 2, [], 0.9).collect()
    assert [r.p_id for r in sorted(got, key=lambda r: r.rank)] == [10, 11]


def test_a_question_without_other_options_stays(spark):
    from pairloom.operators.choices import with_distractors

    q = spark.createDataFrame([(1, "e", "only")], "id long, endpoint string, answer string")
    pool = spark.createDataFrame([("e", "only")], "endpoint string, value string")
    (r,) = with_distractors(q, pool, 3).collect()
    assert r.choices == ["only"] * 4 and r.answer_index == 0


def test_token_counts_beyond_the_broadcast(spark, monkeypatch):
    from pairloom.operators import simjoin as S

    rows = [(i, [f"t{(i * 7 + k) % 90}" for k in range(6)] + [f"u{i // 2}"]) for i in range(120)]
    d = spark.createDataFrame(rows, "id long, bits array<string>").withColumn("ep", F.lit("e"))
    sets = S.distinct_sets(d, ["ep"], "id", "bits")
    want = sorted(map(tuple, S.similar_sets_within(sets, ["ep"], 1, 2).collect()))
    for limit, heavy in ((10, 5), (0, 1)):
        monkeypatch.setattr(S, "BROADCAST_TOKENS", limit)
        monkeypatch.setattr(S, "HEAVY_TOKEN", heavy)
        assert sorted(map(tuple, S.similar_sets_within(sets, ["ep"], 1, 2).collect())) == want
