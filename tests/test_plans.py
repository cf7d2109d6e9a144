"""Physical facts that must hold whatever the data size."""

import pytest
from pyspark.sql import functions as F

from pairloom.operators import simjoin as S
from pairloom.plans.catalog import QUERIES

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["J2_set_join_05", "J4_self_set_join", "J3_edit_join", "J5_similarity_band", "J6_pairs_sharing_key", "K2_nearest", "X13_endpoint_split"])
def test_no_cross_join(spark, name):
    text = plan(QUERIES[name](spark, SF))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    assert "BatchEvalPython" not in text


@pytest.mark.parametrize("name", ["W3_top_per_group", "W8_first_n_per_group", "A23_reason_examples", "K2_nearest"])
def test_top_k_is_limited_before_the_shuffle(spark, name):
    assert "WindowGroupLimit" in plan(QUERIES[name](spark, SF))


def test_scan_reads_only_used_columns(spark):
    text = plan(QUERIES["A14_partner_stats"](spark, SF))
    schema = [line for line in text.splitlines() if "ReadSchema" in line][0]
    assert "l_extendedprice" not in schema and "l_comment" not in schema


def test_prefix_regroup_moves_nothing(spark):
    df = spark.range(50).select(F.lit("e").alias("ep"), "id", F.array(*[(F.col("id") % k).cast("string") for k in (3, 5, 7)]).alias("bits"))
    sets = S.distinct_sets(df, ["ep"], "id", "bits")
    ranked = S.rarest_first(sets, ["ep"], S.frequent_tokens(sets), F.col("n_bits"))
    text = plan(ranked)
    above_explode = text[: text.index("Generate explode")]
    assert "Exchange hashpartitioning" not in above_explode
