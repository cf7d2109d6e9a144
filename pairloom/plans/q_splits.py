"""Splits on the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from pairloom.operators import simjoin as S
from pairloom.operators import splits as X
from pairloom.operators.ordering import ordered_index
from pairloom.plans.frames import SQL_PARITY, SQL_TRADES, parity_docs, trades
from pairloom.plans.registry import query, table
from pairloom.session import cut


def orders(spark, sf):
    return table(spark, sf, "orders").select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority", F.year("o_orderdate").alias("o_year")
    )


def _cut(idx, n, train=0.8, valid=0.1):
    return f"CASE WHEN {idx} < floor({train}::DOUBLE * {n}) THEN 'train' WHEN {idx} < floor({train + valid}::DOUBLE * {n}) THEN 'valid' ELSE 'test' END"


@query("G1_ordered_index", "SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice, o_orderkey) - 1 AS idx, count(*) OVER () AS n FROM orders")
def g1(spark, sf):
    d = ordered_index(orders(spark, sf), [F.col("o_totalprice"), F.col("o_orderkey")])
    return d.select("o_orderkey", "idx", F.col("idx_n").alias("n"))


@query(
    "X1_random",
    f"WITH r AS (SELECT o_orderkey, row_number() OVER (ORDER BY md5('7' || o_orderkey), o_orderkey::VARCHAR) - 1 AS i, count(*) OVER () AS n FROM orders) SELECT o_orderkey, {_cut('i', 'n')} AS split FROM r",
)
def x1(spark, sf):
    return X.random_split(orders(spark, sf), "o_orderkey", seed=7).select("o_orderkey", "split")


@query(
    "X2_random_groups",
    f"""WITH g AS (SELECT DISTINCT o_custkey FROM orders), r AS (SELECT o_custkey, row_number() OVER (ORDER BY md5('7' || o_custkey), o_custkey::VARCHAR) - 1 AS i, count(*) OVER () AS n FROM g)
    SELECT o_orderkey, {_cut('i', 'n')} AS split FROM orders JOIN r USING (o_custkey)""",
)
def x2(spark, sf):
    return X.random_group_split(orders(spark, sf), "o_custkey", seed=7).select("o_orderkey", "split")


@query(
    "X3_stratified",
    """WITH r AS (SELECT o_orderkey, row_number() OVER (PARTITION BY o_orderstatus, o_orderpriority ORDER BY md5('7' || o_orderkey), o_orderkey::VARCHAR) - 1 AS i,
      count(*) OVER (PARTITION BY o_orderstatus, o_orderpriority) AS n FROM orders)
    SELECT o_orderkey, CASE WHEN i < round_even(0.8::DOUBLE * n, 0) THEN 'train' WHEN i < round_even(0.8::DOUBLE * n, 0) + round_even(0.1::DOUBLE * n, 0) THEN 'valid' ELSE 'test' END AS split FROM r""",
)
def x3(spark, sf):
    return X.stratified_split(orders(spark, sf), "o_orderkey", ["o_orderstatus", "o_orderpriority"], seed=7).select(
        "o_orderkey", "split"
    )


@query(
    "X4_ordered_label",
    """WITH o AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice, o_orderkey) - 1 AS i, count(*) OVER () AS n FROM orders),
    r AS (SELECT o_orderkey, row_number() OVER (PARTITION BY i // 10 ORDER BY md5('7' || o_orderkey), o_orderkey) - 1 AS r FROM o WHERE i < n // 10 * 10)
    SELECT o_orderkey, CASE WHEN r < 8 THEN 'train' WHEN r < 9 THEN 'valid' ELSE 'test' END AS split FROM r""",
)
def x4(spark, sf):
    return X.ordered_label_split(orders(spark, sf), "o_orderkey", "o_totalprice", seed=7).select("o_orderkey", "split")


@query(
    "X5_k_fold_by_label",
    "SELECT o_orderkey, CAST(ntile(7) OVER (ORDER BY o_totalprice, o_orderkey) - 1 AS INTEGER) AS fold FROM orders",
)
def x5(spark, sf):
    return X.k_fold_by_label(orders(spark, sf), "o_orderkey", "o_totalprice", 7).select("o_orderkey", "fold")


@query(
    "X5_k_fold_random",
    """WITH r AS (SELECT o_orderkey, row_number() OVER (ORDER BY md5('7' || o_orderkey), o_orderkey::VARCHAR) - 1 AS i, count(*) OVER () AS n FROM orders),
    s AS (SELECT *, n // 3 AS a, (n - n // 3) // 2 AS b FROM r)
    SELECT o_orderkey, CAST(CASE WHEN i < a THEN 0 WHEN i < a + b THEN 1 ELSE 2 END AS INTEGER) AS fold FROM s""",
)
def x5_random(spark, sf):
    return X.k_fold_random(orders(spark, sf), "o_orderkey", 3, seed=7).select("o_orderkey", "fold")


@query(
    "X6_index_order",
    f"WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS i, count(*) OVER () AS n FROM documents) SELECT doc_id, {_cut('i', 'n')} AS split FROM r",
)
def x6(spark, sf):
    return X.order_split(table(spark, sf, "documents").select("doc_id"), ["doc_id"])


@query(
    "X7_specified_ids",
    """SELECT doc_id, CASE WHEN doc_id IN (SELECT item_id * 3 FROM benchmark) THEN 'test' WHEN doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1) THEN 'valid' ELSE 'train' END AS split FROM documents""",
)
def x7(spark, sf):
    d = table(spark, sf, "documents").select("doc_id")
    valid = table(spark, sf, "labels").filter("toxic = 1").select("doc_id")
    test = table(spark, sf, "benchmark").select((F.col("item_id") * 3).alias("doc_id"))
    return X.specified_split(d, "doc_id", valid, test)


@query(
    "X8_property_order",
    f"WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY n_chars, doc_id) - 1 AS i, count(*) OVER () AS n FROM documents) SELECT doc_id, {_cut('i', 'n')} AS split FROM r",
)
def x8(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "n_chars")
    return X.order_split(d, ["n_chars", "doc_id"]).select("doc_id", "split")


@query(
    "X9_time_order",
    f"""WITH r AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, year(o_orderdate) AS y FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
    k AS (SELECT l_orderkey, min(y) AS y FROM r GROUP BY 1), i AS (SELECT l_orderkey, y, row_number() OVER (ORDER BY y, l_orderkey) - 1 AS i, count(*) OVER () AS n FROM k)
    SELECT l_orderkey, y::INTEGER AS o_year, {_cut('i', 'n')} AS split FROM i""",
)
def x9(spark, sf):
    keys = table(spark, sf, "lineitem").select("l_orderkey").distinct()
    years = orders(spark, sf).select(F.col("o_orderkey").alias("l_orderkey"), "o_year")
    return X.time_split(keys, years, "l_orderkey", "o_year").select("l_orderkey", "o_year", "split")


_FIRST = "string_split(text, ' ')[1]"
SQL_GREEDY = f"""g AS (SELECT grp, size, row_number() OVER (ORDER BY size DESC, first DESC) AS k FROM (
    SELECT {_FIRST} AS grp, count(*) AS size, min(doc_id) AS first FROM documents GROUP BY 1)),
n AS (SELECT count(*) AS n FROM documents),
f AS (SELECT 0::BIGINT AS k, 0::HUGEINT AS a, 0::HUGEINT AS b, '' AS grp, '' AS split UNION ALL
  SELECT f.k + 1, a + CASE WHEN a + size <= 0.8::DOUBLE * n.n THEN size ELSE 0 END,
    b + CASE WHEN a + size <= 0.8::DOUBLE * n.n THEN 0 WHEN a + b + size <= (0.8::DOUBLE + 0.1::DOUBLE) * n.n THEN size ELSE 0 END, g.grp,
    CASE WHEN a + size <= 0.8::DOUBLE * n.n THEN 'train' WHEN a + b + size <= (0.8::DOUBLE + 0.1::DOUBLE) * n.n THEN 'valid' ELSE 'test' END
  FROM f JOIN g ON g.k = f.k + 1, n)"""


@query("X10_group_greedy", f"WITH RECURSIVE {SQL_GREEDY} SELECT doc_id, f.split FROM documents JOIN f ON f.grp = {_FIRST}")
def x10(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.split("text", " ")[0].alias("grp"))
    return X.group_greedy_split(d, [], "grp", "doc_id").select("doc_id", "split")


@query(
    "X11_small_groups_to_test",
    f"""WITH d AS (SELECT doc_id, lang, {_FIRST} AS grp FROM documents), t AS (SELECT lang, count(*) AS n FROM d GROUP BY 1),
    g AS (SELECT lang, grp, count(*) AS size, min(doc_id) AS first FROM d GROUP BY 1, 2),
    s AS (SELECT g.*, sum(size) OVER (PARTITION BY g.lang ORDER BY size, first ROWS UNBOUNDED PRECEDING) <= 0.2::DOUBLE * n AS fits FROM g JOIN t USING (lang))
    SELECT doc_id, lang, CASE WHEN fits THEN 'test' ELSE 'train' END AS split FROM d JOIN s USING (lang, grp)""",
)
def x11(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "lang", F.split("text", " ")[0].alias("grp"))
    return X.group_test_first_split(d, ["lang"], "grp", "doc_id").select("doc_id", "lang", "split")


# one sweep over the sets in order: a set is a centre if no earlier centre is its neighbour
SQL_CLUSTERS = f"""{SQL_PARITY}, sets AS (SELECT list_sort(bits) AS bits, min(doc_id) AS first_id, max(doc_id) AS last_id, count(*) AS m, any_value(len(bits)) AS n
    FROM parity WHERE len(bits) > 0 GROUP BY list_sort(bits)),
toks AS (SELECT first_id, n, m, unnest(bits) AS tok FROM sets),
links AS (SELECT a.first_id AS a, b.first_id AS b, any_value(b.m) AS w FROM toks a JOIN toks b ON a.tok = b.tok AND a.first_id <> b.first_id
  GROUP BY 1, 2 HAVING count(*) * 10 >= (any_value(a.n) + any_value(b.n) - count(*)) * 4),
places AS (SELECT first_id, last_id, d, m, row_number() OVER (ORDER BY d DESC, last_id DESC) AS k FROM (
  SELECT first_id, last_id, any_value(m) AS m, coalesce(sum(w), 0) + any_value(m) - 1 AS d FROM sets LEFT JOIN links ON a = first_id GROUP BY 1, 2)),
near AS (SELECT o.k, list(p.k) AS ks FROM links JOIN places o ON o.first_id = links.a JOIN places p ON p.first_id = links.b GROUP BY o.k),
sweep AS (SELECT 0::BIGINT AS k, []::BIGINT[] AS centres UNION ALL
  SELECT s.k + 1, CASE WHEN near.ks IS NULL OR len(list_intersect(near.ks, s.centres)) = 0 THEN list_append(s.centres, s.k + 1) ELSE s.centres END
  FROM sweep s JOIN places o ON o.k = s.k + 1 LEFT JOIN near ON near.k = o.k),
found AS (SELECT centres FROM sweep ORDER BY k DESC LIMIT 1),
owners AS (SELECT p.first_id, p.m, CASE WHEN list_contains(centres, p.k) THEN p.k ELSE list_min(list_intersect(ks, centres)) END AS c
  FROM places p LEFT JOIN near ON near.k = p.k, found),
g AS (SELECT c, size, row_number() OVER (ORDER BY size DESC, c) AS k FROM (SELECT c, sum(m) AS size FROM owners GROUP BY c)),
n AS (SELECT sum(m) AS n FROM sets),
f AS (SELECT 0::BIGINT AS k, 0::HUGEINT AS a, 0::HUGEINT AS b, 0::BIGINT AS c, '' AS split UNION ALL
  SELECT f.k + 1, a + CASE WHEN a + size <= 0.8::DOUBLE * n.n THEN size ELSE 0 END,
    b + CASE WHEN a + size <= 0.8::DOUBLE * n.n THEN 0 WHEN a + b + size <= (0.8::DOUBLE + 0.1::DOUBLE) * n.n THEN size ELSE 0 END, g.c,
    CASE WHEN a + size <= 0.8::DOUBLE * n.n THEN 'train' WHEN a + b + size <= (0.8::DOUBLE + 0.1::DOUBLE) * n.n THEN 'valid' ELSE 'test' END
  FROM f JOIN g ON g.k = f.k + 1, n)"""


@query(
    "X12_cluster_greedy",
    f"""WITH RECURSIVE {SQL_CLUSTERS} SELECT p.doc_id, centre.last_id AS cluster, f.split FROM parity p JOIN sets s ON s.bits = list_sort(p.bits)
    JOIN owners o ON o.first_id = s.first_id JOIN places centre ON centre.k = o.c JOIN f ON f.c = o.c""",
)
def x12(spark, sf):
    d = parity_docs(spark, sf).withColumn("_all", F.lit(0))
    sets = S.distinct_sets(d, ["_all"], "doc_id", "bits")
    members = cut(S.set_members(d, sets, ["_all"], "doc_id", "bits").drop("_all"))
    last = members.groupBy("first_id").agg(F.max("doc_id").alias("last_id"))
    pairs = S.similar_sets_within(sets, ["_all"], 4, 10)
    clusters = X.sphere_clusters(sets.join(last, "first_id"), pairs)
    return X.cluster_greedy_split(members, clusters).select("doc_id", F.col("centre_id").alias("cluster"), "split")


SQL_ENDPOINT_SPLIT = """d AS (SELECT p_partkey, p_type AS dataset_name, p_brand AS endpoint, CASE WHEN p_partkey % 97 = 5 THEN ' ' ELSE p_name END AS repr, p_name || p_size AS grp FROM part),
v AS (SELECT * FROM d WHERE trim(repr) <> ''), s AS (SELECT dataset_name, endpoint, count(*) AS n FROM v GROUP BY ALL),
big AS (SELECT *, least(greatest(5, round_even(0.1::DOUBLE * n, 0)), n - 1)::DOUBLE AS n_test FROM s WHERE n > 10),
g AS (SELECT dataset_name, endpoint, grp, count(*) AS size, min(p_partkey) AS first FROM v JOIN big USING (dataset_name, endpoint) GROUP BY ALL),
gs AS (SELECT g.*, sum(size) OVER (PARTITION BY dataset_name, endpoint ORDER BY size, first ROWS UNBOUNDED PRECEDING) <= n_test / n * n AS fits FROM g JOIN big USING (dataset_name, endpoint)),
a AS (SELECT p_partkey, dataset_name, endpoint, CASE WHEN fits THEN 'test' ELSE 'train' END AS split FROM v JOIN gs USING (dataset_name, endpoint, grp)),
c AS (SELECT dataset_name, endpoint, count(*) FILTER (split = 'test') AS nt, count(*) FILTER (split = 'train') AS na FROM a GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY dataset_name, endpoint, split ORDER BY md5('7' || p_partkey), p_partkey::VARCHAR) - 1 AS i FROM a JOIN c USING (dataset_name, endpoint)),
sp AS (SELECT p_partkey, dataset_name, endpoint, 'train_test' AS split_type, CASE WHEN split = 'train' AND 5 - nt > 0 AND na > 5 - nt AND i < 5 - nt THEN 'test' ELSE split END AS split FROM r
  UNION ALL SELECT p_partkey, dataset_name, endpoint, 'unseen_endpoint_test', 'test' FROM v JOIN s USING (dataset_name, endpoint) WHERE n <= 10)"""


def part_split(spark, sf):
    d = table(spark, sf, "part").select(
        "p_partkey",
        F.col("p_type").alias("dataset_name"),
        F.col("p_brand").alias("endpoint"),
        F.when(F.col("p_partkey") % 97 == 5, " ").otherwise(F.col("p_name")).alias("repr"),
        F.concat("p_name", "p_size").alias("grp"),
    )
    # the thresholds (89 and 30 in large collections) are parameters
    return d, X.endpoint_split(d, ["dataset_name", "endpoint"], "repr", "grp", "p_partkey", 10, 5, seed=7)


@query("X13_endpoint_split", f"WITH {SQL_ENDPOINT_SPLIT} SELECT * FROM sp")
def x13(spark, sf):
    return part_split(spark, sf)[1].select("p_partkey", "dataset_name", "endpoint", "split_type", "split")


@query(
    "X13_endpoint_summary",
    f"""WITH {SQL_ENDPOINT_SPLIT}, t AS (SELECT dataset_name, endpoint, count(*) AS n_total, count(*) FILTER (trim(repr) <> '') AS n_valid_repr FROM d GROUP BY ALL),
    p AS (SELECT dataset_name, endpoint, split_type, count(*) FILTER (split = 'train') AS n_train, count(*) FILTER (split = 'test') AS n_test FROM sp GROUP BY ALL)
    SELECT t.*, coalesce(split_type, 'skip') AS split_type, coalesce(n_train, 0) AS n_train, coalesce(n_test, 0) AS n_test FROM t LEFT JOIN p USING (dataset_name, endpoint)""",
)
def x13_summary(spark, sf):
    d, split = part_split(spark, sf)
    return X.endpoint_split_summary(d, split, ["dataset_name", "endpoint"], "repr")


@query(
    "X14_leakage_repair",
    f"""WITH {SQL_TRADES}, m AS (SELECT endpoint, left_id FROM trades WHERE l_orderkey % 5 = 0 GROUP BY ALL HAVING count(DISTINCT right_id) >= 2)
    SELECT row_id, endpoint, CASE WHEN l_orderkey % 5 = 0 AND (endpoint, left_id) NOT IN (SELECT (endpoint, left_id) FROM m) THEN 'test' ELSE 'train' END AS split FROM trades""",
)
def x14(spark, sf):
    t = trades(spark, sf)
    test, train = X.move_many_partner_rows(
        t.filter("l_orderkey % 5 = 0"), t.filter("l_orderkey % 5 <> 0"), "endpoint", "left_id", "right_id"
    )
    both = test.withColumn("split", F.lit("test")).unionByName(train.withColumn("split", F.lit("train")))
    return both.select("row_id", "endpoint", "split")


@query(
    "X15_gap_fill",
    """WITH RECURSIVE c AS (SELECT label, size, row_number() OVER (ORDER BY size DESC, first) AS k FROM (SELECT label, count(*) AS size, min(vec_id) AS first FROM embeddings GROUP BY 1)),
    n AS (SELECT count(*) AS n FROM embeddings),
    f AS (SELECT 0::BIGINT AS k, 0.8::DOUBLE * n AS a, 0.1::DOUBLE * n AS b, 0.1::DOUBLE * n AS t, 0 AS label, '' AS split FROM n UNION ALL
      SELECT f.k + 1, a - CASE WHEN a >= b AND a >= t THEN size ELSE 0 END, b - CASE WHEN a >= b AND a >= t THEN 0 WHEN b >= t THEN size ELSE 0 END,
        t - CASE WHEN a >= b AND a >= t THEN 0 WHEN b >= t THEN 0 ELSE size END, c.label, CASE WHEN a >= b AND a >= t THEN 'train' WHEN b >= t THEN 'valid' ELSE 'test' END
      FROM f JOIN c ON c.k = f.k + 1)
    SELECT vec_id, f.split FROM embeddings e JOIN f ON f.label = e.label AND f.k > 0""",
)
def x15(spark, sf):
    e = table(spark, sf, "embeddings").select("vec_id", "label")
    return X.gap_fill_split(e, "label", "vec_id").select("vec_id", "split")
