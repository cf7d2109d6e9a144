"""Typed inputs of the operators, derived from the driver tables, with the same as SQL text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairloom.functions.sets import words
from pairloom.plans.registry import table

SQL_WORDS = (
    "list_distinct(list_filter(regexp_split_to_array(lower({0}), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> ''))"
)
SQL_FRAGMENTS = (
    "list_filter(list_transform(string_split(coalesce({0}, ''), '.'), lambda x: trim(x)), lambda x: x <> '')"
)


# --- labelled entities: documents with their toxicity label ----------------------------------
def labelled(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents")
    lab = table(spark, sf, "labels")
    return d.join(lab, "doc_id").select(
        F.col("doc_id").alias("entity_id"),
        F.col("lang").alias("dataset_name"),
        F.col("source").alias("endpoint"),
        F.col("toxic").alias("label"),
        F.col("text").alias("repr"),
        "quality",
        "n_chars",
    )


SQL_LABELLED = """labelled AS (
  SELECT d.doc_id AS entity_id, d.lang AS dataset_name, d.source AS endpoint, l.toxic AS label,
         d.text AS repr, l.quality, d.n_chars
  FROM documents d JOIN labels l ON d.doc_id = l.doc_id)"""


# --- all documents, labelled by parity, with their words as bits -------------------------------
def parity_docs(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents")
    return d.select(
        "doc_id",
        "lang",
        "source",
        (F.col("doc_id") % 2).cast("int").alias("label"),
        "text",
        words(F.col("text")).alias("bits"),
    )


SQL_PARITY = f"""parity AS (
  SELECT doc_id, lang, source, CAST(doc_id % 2 AS INTEGER) AS label, text,
         {SQL_WORDS.format('text')} AS bits
  FROM documents)"""


# --- pairs: a user turn and the assistant turn after it ----------------------------------------
def turns(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "conversations")
    u = c.filter("role = 'user'").select("conv_id", "turn", F.col("text").alias("left_repr"))
    a = c.filter("role = 'assistant'").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("right_repr")
    )
    return u.join(a, ["conv_id", "turn"]).select(
        (F.col("conv_id") * 100 + F.col("turn")).alias("source_index"),
        F.concat(F.lit("set"), (F.col("conv_id") % 3).cast("string")).alias("dataset_name"),
        F.concat(F.lit("ep"), (F.col("conv_id") % 7).cast("string")).alias("endpoint"),
        "left_repr",
        "right_repr",
        "conv_id",
        "turn",
    )


SQL_TURNS = """turns AS (
  SELECT u.conv_id * 100 + u.turn AS source_index, 'set' || CAST(u.conv_id % 3 AS VARCHAR) AS dataset_name,
         'ep' || CAST(u.conv_id % 7 AS VARCHAR) AS endpoint, u.text AS left_repr, a.text AS right_repr,
         u.conv_id, u.turn
  FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1
  WHERE u.role = 'user' AND a.role = 'assistant')"""


# --- entity pairs with many partners and numeric properties: parts and their suppliers ---------
def trades(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem")
    return li.select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("row_id"),
        F.col("l_linestatus").alias("dataset_name"),
        F.col("l_returnflag").alias("endpoint"),
        F.col("l_partkey").alias("left_id"),
        F.col("l_suppkey").alias("right_id"),
        "l_quantity",
        "l_extendedprice",
        "l_discount",
        "l_tax",
        "l_orderkey",
    )


SQL_TRADES = """trades AS (
  SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS row_id,
         l_linestatus AS dataset_name, l_returnflag AS endpoint, l_partkey AS left_id,
         l_suppkey AS right_id, l_quantity, l_extendedprice, l_discount, l_tax, l_orderkey
  FROM lineitem)"""
TRADE_PROPS = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


# --- two candidate outputs per conversation turn: predictions and gold answers -----------------
def predictions(spark: SparkSession, sf: str) -> DataFrame:
    """Each turn is a prediction; gold is the same conversation's next turn, both of any role."""
    c = table(spark, sf, "conversations")
    nxt = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("gold"))
    return c.join(nxt, ["conv_id", "turn"]).select(
        (F.col("conv_id") * 100 + F.col("turn")).alias("id"),
        F.concat(F.lit("m"), (F.col("conv_id") % 3).cast("string")).alias("model"),
        F.concat(F.lit("task"), (F.col("turn") % 2 + 1).cast("string")).alias("task"),
        F.when(F.length("text") > 300, "multi_step").otherwise("one_step").alias("step"),
        F.when(F.col("conv_id") % 2 == 0, "repr_a").otherwise("repr_b").alias("repre"),
        F.concat(F.lit("set"), (F.col("conv_id") % 5).cast("string")).alias("dataset_name"),
        F.concat(F.lit("ep"), (F.col("conv_id") % 7).cast("string")).alias("endpoint"),
        F.col("text").alias("pred"),
        "gold",
        "conv_id",
        "turn",
    )


SQL_PREDICTIONS = """predictions AS (
  SELECT p.conv_id * 100 + p.turn AS id, 'm' || CAST(p.conv_id % 3 AS VARCHAR) AS model,
         'task' || CAST(p.turn % 2 + 1 AS VARCHAR) AS task,
         CASE WHEN length(p.text) > 300 THEN 'multi_step' ELSE 'one_step' END AS step,
         CASE WHEN p.conv_id % 2 = 0 THEN 'repr_a' ELSE 'repr_b' END AS repre,
         'set' || CAST(p.conv_id % 5 AS VARCHAR) AS dataset_name,
         'ep' || CAST(p.conv_id % 7 AS VARCHAR) AS endpoint,
         p.text AS pred, g.text AS gold, p.conv_id, p.turn
  FROM conversations p JOIN conversations g ON g.conv_id = p.conv_id AND g.turn = p.turn + 1)"""
