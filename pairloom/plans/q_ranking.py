"""Window, ranking and nearest-neighbour queries on the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from pairloom.functions.sets import words
from pairloom.operators import choices, knn
from pairloom.operators import joins as J
from pairloom.operators import ranking as W
from pairloom.operators.setops import first_rows
from pairloom.plans.frames import SQL_PARITY, SQL_TURNS, SQL_WORDS, parity_docs, turns
from pairloom.plans.q_aggregates import SQL_SCORED, scored
from pairloom.plans.q_filters import SQL_KINDS, kinds
from pairloom.plans.registry import query, table


@query(
    "W1_share_of_group",
    """WITH g AS (SELECT l_returnflag, l_linestatus, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL)
    SELECT *, round(n / sum(n) OVER (PARTITION BY l_returnflag, l_linestatus), 8) AS share FROM g""",
)
def w1(spark, sf):
    g = table(spark, sf, "lineitem").groupBy("l_returnflag", "l_linestatus", "l_linenumber").agg(F.count(F.lit(1)).alias("n"))
    return W.share_of_group(g, "n", ["l_returnflag", "l_linestatus"]).withColumn("share", F.round("share", 8))


@query(
    "W2_ranked_top",
    """SELECT CAST(row_number() OVER (ORDER BY o_totalprice DESC, o_orderpriority, o_orderkey) AS INTEGER) AS rank, o_orderkey, o_totalprice FROM orders
    ORDER BY o_totalprice DESC, o_orderpriority, o_orderkey LIMIT 50""",
)
def w2(spark, sf):
    order = [F.desc("o_totalprice"), F.col("o_orderpriority"), F.col("o_orderkey")]
    return W.top_rows(table(spark, sf, "orders"), order, 50).select("rank", "o_orderkey", "o_totalprice")


@query(
    "W3_top_per_group",
    f"""WITH {SQL_SCORED} SELECT task, step, model, id, rank FROM (SELECT task, step, model, id,
      CAST(row_number() OVER (PARTITION BY task, step, model ORDER BY m1 DESC NULLS LAST, id) AS INTEGER) AS rank FROM scored) WHERE rank <= 2""",
)
def w3(spark, sf):
    d = W.top_per_group(scored(spark, sf), ["task", "step", "model"], [F.desc_nulls_last("m1"), F.col("id")], 2)
    return d.select("task", "step", "model", "id", "rank")


@query(
    "W4_number_duplicates",
    """WITH r AS (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS k FROM events)
    SELECT event_id, CASE WHEN k = 0 THEN user_id::VARCHAR ELSE user_id || '_' || k END AS unique_key FROM r""",
)
def w4(spark, sf):
    e = table(spark, sf, "events").select("event_id", "user_id")
    return W.number_duplicates(e, "user_id", [F.col("event_id")]).select("event_id", "unique_key")


@query(
    "W5_first_per_key",
    """SELECT l_partkey, l_suppkey, l_orderkey, l_linenumber FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey, l_suppkey ORDER BY l_orderkey, l_linenumber) AS rn FROM lineitem) WHERE rn = 1""",
)
def w5(spark, sf):
    li = table(spark, sf, "lineitem").select("l_partkey", "l_suppkey", "l_orderkey", "l_linenumber")
    return first_rows(li, ["l_partkey", "l_suppkey"], ["l_orderkey", "l_linenumber"])


@query(
    "W6_shuffled_ids",
    f"WITH {SQL_SCORED} SELECT task, step, id AS old_id, row_number() OVER (PARTITION BY task, step ORDER BY md5('42' || id), id::VARCHAR) - 1 AS new_id FROM scored",
)
def w6(spark, sf):
    s = scored(spark, sf).select("task", "step", F.col("id").alias("old_id"))
    return W.shuffled_ids(s, 42, F.col("old_id"), ["task", "step"], "new_id")


@query(
    "W7_prefer_test",
    """WITH d AS (SELECT text, lang, doc_id, CASE WHEN doc_id % 4 = 0 THEN 'test' ELSE 'train' END AS split FROM documents),
    r AS (SELECT *, row_number() OVER (PARTITION BY text, lang ORDER BY CASE WHEN split = 'test' THEN 0 ELSE 1 END, doc_id) AS rn FROM d)
    SELECT md5(text) AS code, lang, doc_id, split FROM r WHERE rn = 1""",
)
def w7(spark, sf):
    d = table(spark, sf, "documents").select(
        F.md5("text").alias("code"), "lang", "doc_id", F.when(F.col("doc_id") % 4 == 0, "test").otherwise("train").alias("split")
    )
    return W.prefer_test(d, ["code", "lang"], ["doc_id"])


@query(
    "W8_first_n_per_group",
    f"""WITH {SQL_KINDS}, k AS (SELECT source_index, CASE WHEN n_fg_diff = 0 THEN NULL ELSE n_fg_diff END AS kind, n_diff_features FROM kinds)
    SELECT source_index, kind, n_diff_features FROM (SELECT *, row_number() OVER (PARTITION BY kind, n_diff_features ORDER BY source_index) AS rn FROM k) WHERE rn <= 3""",
)
def w8(spark, sf):
    k = kinds(spark, sf).select("source_index", F.nullif("n_fg_diff", F.lit(0)).alias("kind"), "n_diff_features")
    return W.top_per_group(k, ["kind", "n_diff_features"], [F.col("source_index")], 3).drop("rank")


# --- nearest neighbours: every tenth document asks, the others answer -----------------------------

SQL_KNN = f"""{SQL_PARITY}, e AS (SELECT doc_id, lang, md5(text) AS anchor, bits, len(bits) AS n FROM parity),
tq AS (SELECT doc_id AS q_id, lang, unnest(bits) AS tok FROM e WHERE doc_id % 10 = 0),
tp AS (SELECT doc_id AS p_id, lang, unnest(bits) AS tok FROM e WHERE doc_id % 10 <> 0),
o AS (SELECT q_id, p_id, count(*) AS i FROM tq JOIN tp USING (lang, tok) GROUP BY 1, 2),
cand AS (SELECT q.lang, q.doc_id AS q_id, p.doc_id AS p_id, p.anchor AS p_anchor, coalesce(i, 0) / greatest(q.n + p.n - coalesce(i, 0), 1) AS sim
  FROM e q JOIN e p ON q.lang = p.lang AND q.doc_id % 10 = 0 AND p.doc_id % 10 <> 0 AND q.anchor <> p.anchor
  LEFT JOIN o ON o.q_id = q.doc_id AND o.p_id = p.doc_id),
nn AS (SELECT lang, q_id, p_id, sim, row_number() OVER (PARTITION BY q_id ORDER BY sim DESC, p_id) AS rank FROM cand)"""


def knn_sides(spark, sf):
    d = parity_docs(spark, sf).select("doc_id", "lang", "source", "text", F.md5("text").alias("anchor"), "bits")
    ask = d.filter("doc_id % 10 = 0")
    pool = d.filter("doc_id % 10 <> 0")
    q = ask.select("lang", F.col("doc_id").alias("q_id"), F.col("anchor").alias("q_anchor"), F.col("bits").alias("q_bits"))
    p = pool.select("lang", F.col("doc_id").alias("p_id"), F.col("anchor").alias("p_anchor"), F.col("bits").alias("p_bits"))
    return ask, pool, q, p


@query(
    "K1_top_k_for_entity",
    f"""WITH {SQL_PARITY}, t AS (SELECT bits AS q FROM parity WHERE doc_id = 11), s AS (SELECT doc_id, len(list_intersect(bits, q)) AS i, len(bits) + len(q) AS n FROM parity, t WHERE doc_id <> 11)
    SELECT doc_id, round(i / greatest(n - i, 1), 6) AS sim FROM s ORDER BY i / greatest(n - i, 1) DESC, doc_id LIMIT 20""",
)
def k1(spark, sf):
    d = knn.top_k_for_entity(parity_docs(spark, sf), "doc_id", "bits", 11, 20)
    return d.withColumn("sim", F.round("sim", 6))


@query(
    "K2_error_records",
    f"""WITH {SQL_KNN}, n2 AS (SELECT cand.lang, q_id, p_id, sim, row_number() OVER (PARTITION BY q_id ORDER BY sim DESC, p_id) AS rank FROM cand JOIN e p ON p.doc_id = p_id
      WHERE q_id % 70 <> 0 AND p.n % 5 <> 0)
    SELECT lang, q_id, CAST(rank AS INTEGER) AS rank, p_id, round(sim, 6) AS sim, NULL AS error FROM n2 WHERE rank <= 2
    UNION ALL SELECT lang, doc_id, NULL, NULL, NULL, CASE WHEN doc_id % 70 = 0 THEN 'no features' END FROM e WHERE doc_id % 10 = 0 AND doc_id NOT IN (SELECT q_id FROM n2)""",
)
def k2_errors(spark, sf):
    _, _, q, p = knn_sides(spark, sf)
    q = q.withColumn("q_bits", F.when(F.col("q_id") % 70 != 0, F.col("q_bits")))
    p = p.withColumn("p_other", F.when(F.size("p_bits") % 5 == 0, F.col("p_anchor")).otherwise("other side"))
    return knn.nearest_records(q, p, 2, ["lang"]).withColumn("sim", F.round("sim", 6))


@query("K2_nearest", f"WITH {SQL_KNN} SELECT lang, q_id, CAST(rank AS INTEGER) AS rank, p_id, round(sim, 6) AS sim FROM nn WHERE rank <= 10")
def k2(spark, sf):
    _, _, q, p = knn_sides(spark, sf)
    return knn.nearest(q, p, 10, ["lang"]).withColumn("sim", F.round("sim", 6))


@query(
    "K3_nearest_distinct_anchor",
    f"""WITH {SQL_KNN}, a AS (SELECT *, row_number() OVER (PARTITION BY q_id, p_anchor ORDER BY sim DESC, p_id) AS ar FROM cand),
    r AS (SELECT lang, q_id, p_id, sim, row_number() OVER (PARTITION BY q_id ORDER BY sim DESC, p_id) AS rank FROM a WHERE ar = 1)
    SELECT lang, q_id, CAST(rank AS INTEGER) AS rank, p_id, round(sim, 6) AS sim FROM r WHERE rank <= 10""",
)
def k3(spark, sf):
    _, _, q, p = knn_sides(spark, sf)
    return knn.nearest(q, p, 10, ["lang"], distinct_anchor=True).withColumn("sim", F.round("sim", 6))


@query(
    "K4_nearest_within_table",
    f"""WITH {SQL_TURNS}, e AS (SELECT source_index, endpoint, left_repr, {SQL_WORDS.format('left_repr')} AS b FROM turns),
    c AS (SELECT x.endpoint, x.source_index AS q_id, y.source_index AS p_id, len(list_intersect(x.b, y.b)) AS i, len(x.b) + len(y.b) AS n
      FROM e x JOIN e y ON x.endpoint = y.endpoint AND x.left_repr <> y.left_repr),
    r AS (SELECT *, i / greatest(n - i, 1) AS sim, row_number() OVER (PARTITION BY q_id ORDER BY i / greatest(n - i, 1) DESC, p_id) AS rank FROM c)
    SELECT endpoint, q_id, CAST(rank AS INTEGER) AS rank, p_id, round(sim, 6) AS sim FROM r WHERE rank <= 5""",
)
def k4(spark, sf):
    t = turns(spark, sf).withColumn("b", words(F.col("left_repr")))
    q = t.select("endpoint", F.col("source_index").alias("q_id"), F.col("left_repr").alias("q_anchor"), F.col("b").alias("q_bits"))
    p = t.select("endpoint", F.col("source_index").alias("p_id"), F.col("left_repr").alias("p_anchor"), F.col("b").alias("p_bits"))
    return knn.nearest(q, p, 5, ["endpoint"]).withColumn("sim", F.round("sim", 6))


SQL_CHOICES = """pool AS (SELECT DISTINCT p_brand AS endpoint, p_name AS v FROM part WHERE trim(p_name) <> ''),
own AS (SELECT endpoint, v, row_number() OVER (PARTITION BY endpoint ORDER BY md5('5' || v), v) - 1 AS pos, count(*) OVER (PARTITION BY endpoint) AS m FROM pool),
every AS (SELECT v, row_number() OVER (ORDER BY md5('5' || v), v) - 1 AS pos, count(*) OVER () AS m FROM (SELECT DISTINCT v FROM pool)),
qs AS (SELECT o_orderkey AS id, 'Brand#' || (o_orderkey % 30) AS endpoint, p_name AS answer FROM orders JOIN part ON p_partkey = o_orderkey % (SELECT count(*) FROM part)),
sz AS (SELECT endpoint, any_value(m) AS m FROM own GROUP BY 1),
q1 AS (SELECT id, answer, endpoint, sz.m, coalesce(sz.m, 0) - CASE WHEN (endpoint, answer) IN (SELECT (endpoint, v) FROM own) THEN 1 ELSE 0 END >= 3 AS enough FROM qs LEFT JOIN sz USING (endpoint)),
q2 AS (SELECT id, answer, CASE WHEN enough THEN endpoint END AS endpoint, CASE WHEN enough THEN m ELSE (SELECT max(m) FROM every) END AS m,
  CAST('0x' || substr(md5('5' || id), 1, 15) AS BIGINT) AS h FROM q1),
q3 AS (SELECT id, answer, endpoint, j, (h + j) % m AS pos FROM q2, (SELECT unnest(range(8)) AS j) WHERE j <= CASE WHEN m > 3 THEN 3 ELSE 7 END),
met AS (SELECT id, answer, j, own.v FROM q3 JOIN own ON own.endpoint = q3.endpoint AND own.pos = q3.pos WHERE own.v <> answer
  UNION ALL SELECT id, answer, j, every.v FROM q3 JOIN every ON q3.endpoint IS NULL AND every.pos = q3.pos WHERE every.v <> answer),
r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY j) AS rn FROM met),
o AS (SELECT id, v FROM r WHERE rn <= 3 UNION ALL SELECT id, answer FROM qs UNION ALL SELECT id, answer FROM (SELECT id, answer, unnest(range(3 - (SELECT count(*) FROM r WHERE r.id = qs.id AND rn <= 3))) FROM qs)),
s AS (SELECT id, list(v ORDER BY md5('6' || id || v), v) AS vs FROM o GROUP BY id),
mcq AS (SELECT s.id, answer, vs, CAST(list_position(vs, answer) - 1 AS INTEGER) AS answer_index FROM s JOIN qs ON qs.id = s.id)"""


@query(
    "K5_distractors",
    f"WITH {SQL_CHOICES} SELECT id, array_to_string(vs, '|') AS choices, answer_index FROM mcq",
)
def k5(spark, sf):
    d = choice_frame(spark, sf)
    return d.select("id", F.array_join("choices", "|").alias("choices"), "answer_index")


def choice_frame(spark, sf):
    part = table(spark, sf, "part")
    q = (
        table(spark, sf, "orders")
        .select(F.col("o_orderkey").alias("id"), "o_orderkey")
        .crossJoin(F.broadcast(part.agg(F.count(F.lit(1)).alias("n"))))  # one row
        .select("id", (F.col("o_orderkey") % F.col("n")).alias("p_partkey"))
        .join(part.select("p_partkey", F.col("p_name").alias("answer")), "p_partkey")
        .select("id", F.concat(F.lit("Brand#"), F.col("id") % 30).alias("endpoint"), "answer")
    )
    pool = part.select(F.col("p_brand").alias("endpoint"), F.col("p_name").alias("value"))
    return choices.with_distractors(q, pool, 3, pick_seed=5, order_seed=6)


@query(
    "K6_similar_distractors",
    f"""WITH {SQL_KNN}, v AS (SELECT lang, q_id, p_anchor AS value, max(sim) AS sim, min_by(p_id, struct_pack(a := -sim, b := p_id)) AS p_id FROM cand WHERE sim <= 0.9 OR q_id NOT IN (SELECT q_id FROM cand WHERE sim <= 0.9) GROUP BY ALL),
    r AS (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY sim DESC, p_id) AS rank FROM v)
    SELECT lang, q_id, CAST(rank AS INTEGER) AS rank, p_id, round(sim, 6) AS sim FROM r WHERE rank <= 3""",
)
def k6(spark, sf):
    _, _, q, p = knn_sides(spark, sf)
    return knn.nearest_or_any(q, p, 3, ["lang"], 0.9, distinct_anchor=True).withColumn("sim", F.round("sim", 6))


@query("K7_first_rows", "SELECT event_id, event_type FROM events ORDER BY event_id LIMIT 30")
def k7(spark, sf):
    return table(spark, sf, "events").select("event_id", "event_type").orderBy("event_id").limit(30)


@query("K8_bottom_pairs", f"WITH {SQL_KINDS} SELECT source_index, n_only_left FROM cmp WHERE n_only_left > 0 ORDER BY n_only_left, source_index LIMIT 5")
def k8(spark, sf):
    from pairloom.plans.q_filters import compared

    d = compared(spark, sf).select("source_index", F.nullif("n_only_left", F.lit(0)).cast("long").alias("n_only_left"))
    return d.dropna().orderBy("n_only_left", "source_index").limit(5)


SQL_SHOTS = f"""{SQL_KNN}, tr AS (SELECT doc_id, source, string_split(text, ' ')[1] AS w FROM documents),
sh AS (SELECT nn.q_id, nn.rank, nn.p_id, p.source, p.w FROM nn JOIN tr p ON p.doc_id = nn.p_id JOIN tr q ON q.doc_id = nn.q_id
  WHERE nn.rank <= 10 AND NOT (p.source = q.source AND p.w = q.w)),
s1 AS (SELECT *, row_number() OVER (PARTITION BY q_id, source, w ORDER BY rank) AS f FROM sh),
s2 AS (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY rank) AS n FROM s1 WHERE f = 1),
shots AS (SELECT q_id, string_agg(p_id || ':' || w, ',' ORDER BY n) AS examples FROM s2 WHERE n <= 4 GROUP BY q_id)"""


def shots(spark, sf, k=4):
    ask, pool, q, p = knn_sides(spark, sf)
    first = F.split("text", " ")[0].alias("w")
    test = ask.select(F.col("doc_id").alias("q_id"), "source", first)
    train = pool.select(F.col("doc_id").alias("p_id"), "source", first)
    return J.few_shot_examples(knn.nearest(q, p, 10, ["lang"]), test, train, ["source", "w"], ["w"], k)


def example_text(column):
    return F.array_join(F.transform(column, lambda e: F.concat(e["p_id"].cast("string"), F.lit(":"), e["w"])), ",")


@query("J18_few_shot_examples", f"WITH {SQL_SHOTS} SELECT q_id, examples FROM shots")
def j18(spark, sf):
    return shots(spark, sf).select("q_id", example_text("examples").alias("examples"))
