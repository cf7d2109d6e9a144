"""Grid joins of every kind against plain joins, with keys that hold most rows."""

import pytest

from pyspark.sql import functions as F

from pairloom.operators import metrics, skew, splits
from pairloom.operators.skew import grid_join

LEFT = "x string, y long, l long"
RIGHT = "x string, y long, r long"


@pytest.fixture(scope="module")
def sides(spark):
    left = [("hot", 1, k) for k in range(60)] + [(None, 1, k) for k in range(100, 140)]
    left += [("lonely", 2, k) for k in range(200, 230)] + [("few", 3, 300), ("few", None, 301), (None, None, 302)]
    right = [("hot", 1, k) for k in range(9)] + [(None, 1, 20), ("few", 3, 21), ("few", None, 22), ("right", 1, 23)]
    return spark.createDataFrame(left, LEFT).repartition(3), spark.createDataFrame(right, RIGHT).repartition(2)


@pytest.mark.parametrize("cell", [4, 25, 1000])
@pytest.mark.parametrize("how", ["inner", "left"])
@pytest.mark.parametrize("null_safe", [False, True])
def test_grid_join_equals_join(sides, cell, how, null_safe):
    a, b = (d.collect() for d in sides)
    same = lambda p, q: p == q and (null_safe or None not in p)
    want = []
    for p in a:
        hits = [q.r for q in b if same((p.x, p.y), (q.x, q.y))]
        want += [(p.x, p.y, p.l, r) for r in hits or ([None] if how == "left" else [])]
    left, right = sides
    got = grid_join(left, right, ["x", "y"], left["l"], right["r"], cell_rows=cell, how=how, null_safe=null_safe)
    assert got.columns == ["x", "y", "l", "r"]
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))


def test_a_key_of_many_pairs_is_dealt_though_it_has_few_rows(spark, monkeypatch):
    monkeypatch.setattr(skew, "PAIR_SIDE", 50, raising=False)
    left = spark.range(400).selectExpr("'hot' AS k", "id AS l").unionAll(spark.createDataFrame([("few", 1)], "k string, l long"))
    right = spark.range(300).selectExpr("'hot' AS k", "id AS r").unionAll(spark.createDataFrame([("few", 1)], "k string, r long"))
    got = grid_join(left, right, ["k"], left["l"], right["r"]).withColumn("task", F.spark_partition_id())
    assert got.select("k", "l", "r").distinct().count() == got.count() == 120_001
    tasks = [r["count"] for r in got.groupBy("task").count().collect()]
    assert len(tasks) > 4 and max(tasks) < 60_000


@pytest.mark.parametrize("bound", [0, 200_000])
@pytest.mark.parametrize("how, null_safe", [("left", False), ("inner", True), ("left", True)])
def test_lookup(spark, monkeypatch, bound, how, null_safe):
    monkeypatch.setattr(skew, "BROADCAST_KEYS", bound)
    rows = [("hot", k) for k in range(90)] + [(None, 200), ("x", 201), ("absent", 202)]
    table = [("hot", 1), (None, 2), ("x", 3), ("other", 4)]
    left, right = spark.createDataFrame(rows, "k string, v long"), spark.createDataFrame(table, "k string, w int")
    want = []
    for k, v in rows:
        w = [b for a, b in table if a == k and (null_safe or k is not None)]
        want += [(k, v, b) for b in w or ([None] if how == "left" else [])]
    got = skew.lookup(left, right, ["k"], skew.row_hash(left), how, null_safe).select("k", "v", "w").collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


@pytest.mark.parametrize("bound", [0, 200_000])
def test_one_group_with_half_of_all_rows(spark, monkeypatch, bound):
    monkeypatch.setattr(skew, "BROADCAST_KEYS", bound)
    df = spark.range(400).selectExpr("id", "CASE WHEN id < 200 THEN 'big' WHEN id < 210 THEN NULL ELSE 'g' || CAST(id % 30 AS string) END AS g")
    for split in (
        splits.random_group_split(df, "g"),
        splits.group_greedy_split(df.filter("g IS NOT NULL"), [], "g", "id"),
        splits.gap_fill_split(df.filter("g IS NOT NULL"), "g", "id"),
    ):
        rows = split.collect()
        assert len({r.id for r in rows}) == len(rows) >= 390
        assert len({(r.g, r.split) for r in rows}) == len({r.g for r in rows})


@pytest.mark.parametrize("bound", [0, 200_000])
def test_blank_predictions_stay_out_of_the_join(spark, monkeypatch, bound):
    monkeypatch.setattr(skew, "BROADCAST_KEYS", bound)
    df = spark.range(300).selectExpr("id", "CASE WHEN id % 10 < 9 THEN CASE WHEN id % 2 = 0 THEN ' ' END ELSE 'c' || CAST(id % 3 AS string) END AS pred")
    table = spark.createDataFrame([(f"c{i}", f"d{i}") for i in range(3)], "code string, decoded string")
    for c in ("canon", "error"):
        table = table.withColumn(c, F.col("decoded"))
    for c in metrics.BITS:
        table = table.withColumn(f"bits_{c}", F.array("decoded"))
    got = metrics.decoded_as(df, "pred", table, "p").collect()
    assert len(got) == 300 and all((r.p_decoded is None) == (r.id % 10 < 9) for r in got)
    if bound == 0:
        text = metrics.decoded_as(df, "pred", table, "p")._jdf.queryExecution().optimizedPlan().toString()
        assert text.lstrip().startswith("Union") and "Join" not in text[text.index("\n+- "):]
