"""Multiple-choice options."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairloom.operators.ordering import attach, hash_rank

ENOUGH = 3  # distinct other values an endpoint must offer to be used alone


def hash_number(text: Column) -> Column:
    """Non-negative 60-bit integer from the first hex digits of the md5."""
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def _seeded(seed: int, *parts: Column) -> Column:
    return F.concat(F.lit(str(seed)), *[p.cast("string") for p in parts])


def with_distractors(
    questions: DataFrame, pool: DataFrame, n: int = 3, pick_seed: int = 0, order_seed: int = 1
) -> DataFrame:
    """``n`` wrong options per question, mixed with the answer, and the answer's 0-based place.

    ``questions``: id, endpoint, answer; ``pool``: endpoint, value. The options come from the own
    endpoint if it has at least three other values, else from all. The values of a pool stand in a
    seeded order on a ring; a question starts at a hash of its id and takes the next ones that are
    not its answer, so it meets n + 1 values and never the whole pool. A pool that is too small is
    gone round again; what is still missing is filled with the answer.
    """
    values = pool.filter(F.trim(F.coalesce("value", F.lit(""))) != "").select("endpoint", "value").distinct()
    own = hash_rank(values, pick_seed, F.col("value"), ["endpoint"], "pos").withColumnRenamed("pos_n", "m")
    every = hash_rank(values.select("value").distinct(), pick_seed, F.col("value"), (), "pos").select(
        F.lit(None).cast("string").alias("endpoint"), "value", "pos", F.col("pos_n").alias("m")
    )
    sizes = own.groupBy("endpoint").agg(F.first("m").alias("_m"))
    total = every.agg(F.max("m").alias("_all"))
    here = own.select("endpoint", F.col("value").alias("answer"), F.lit(1).alias("_in"))
    q = attach(questions.select("id", "endpoint", "answer"), sizes, ["endpoint"], "left")
    q = attach(q, here, ["endpoint", "answer"], "left").crossJoin(F.broadcast(total))  # one row
    enough = F.coalesce(F.col("_m"), F.lit(0)) - F.coalesce(F.col("_in"), F.lit(0)) >= ENOUGH
    q = q.select(
        "id",
        "answer",
        F.when(enough, F.col("endpoint")).alias("endpoint"),
        F.when(enough, F.col("_m")).otherwise(F.col("_all")).alias("m"),
    )
    steps = F.when(F.col("m") > n, n).otherwise(2 * n + 1)
    start = hash_number(_seeded(pick_seed, F.col("id")))
    q = q.withColumn("j", F.explode(F.sequence(F.lit(0), steps))).withColumn("pos", (start + F.col("j")) % F.col("m"))
    ring = own.select("endpoint", "pos", "value").unionByName(every.select("endpoint", "pos", "value"))
    met = attach(q, ring, ["endpoint", "pos"]).filter(F.col("value") != F.col("answer"))
    chosen = met.groupBy("id").agg(F.slice(F.sort_array(F.collect_list(F.struct("j", "value"))), 1, n).alias("_c"))
    # a question whose pool holds nothing but its answer keeps its place, filled up with the answer
    chosen = questions.select("id", "answer").join(chosen, "id", "left")
    found = F.transform(F.coalesce("_c", F.array().cast(chosen.schema["_c"].dataType)), lambda c: c["value"])
    options = F.concat(found, F.array_repeat("answer", n - F.size(found)), F.array("answer"))
    mixed = F.sort_array(
        F.transform(options, lambda v: F.struct(F.md5(_seeded(order_seed, F.col("id"), v)).alias("h"), v.alias("v")))
    )
    d = chosen.withColumn("choices", F.transform(mixed, lambda x: x["v"]))
    return d.select(
        "id", "answer", "choices", (F.array_position("choices", F.col("answer")) - 1).cast("int").alias("answer_index")
    )


def letter(index: Column) -> Column:
    return F.char(F.lit(65) + index)
