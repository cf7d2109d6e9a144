"""Joins on the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from pairloom.functions.sets import words
from pairloom.operators import joins as J
from pairloom.operators import contrast, rowdiff
from pairloom.operators import simjoin as S
from pairloom.plans.frames import (
    SQL_PARITY,
    SQL_PREDICTIONS,
    SQL_TURNS,
    SQL_WORDS,
    parity_docs,
    predictions,
    turns,
)
from pairloom.plans.part_pairs import SQL_PART_PAIRS, part_entities, part_pairs
from pairloom.plans.registry import query, table
from pairloom.session import together

# --- set joins: documents of one language, odd ids against even ids ------------------------------

SQL_SETS = f"""{SQL_PARITY}, sets AS (
  SELECT lang, label, list_sort(bits) AS bits, min(doc_id) AS first_id, count(*) AS n_members, any_value(len(bits)) AS n
  FROM parity WHERE len(bits) > 0 GROUP BY lang, label, list_sort(bits)),
toks AS (SELECT lang, label, first_id, n, n_members, unnest(bits) AS tok FROM sets),
overlap AS (SELECT a.lang, a.first_id AS l_id, b.first_id AS r_id, any_value(a.n) AS ln, any_value(b.n) AS rn,
    any_value(a.n_members * b.n_members) AS n_pairs, count(*) AS i
  FROM toks a JOIN toks b ON a.lang = b.lang AND a.tok = b.tok WHERE a.label = 1 AND b.label = 0 GROUP BY 1, 2, 3),
sims AS (SELECT *, ln + rn - i AS u FROM overlap)"""


def parity_sets(spark, sf):
    d = parity_docs(spark, sf)
    side = lambda v: S.distinct_sets(d.filter(F.col("label") == v), ["lang"], "doc_id", "bits")
    return together(lambda: side(1), lambda: side(0))


def _set_join(num, den):
    def run(spark, sf):
        left, right = parity_sets(spark, sf)
        return S.similar_sets(left, right, ["lang"], num, den).select(
            "lang", "l_id", "r_id", "n_common", "n_union", F.round("sim", 6).alias("sim"), "n_pairs"
        )

    return run


def _set_join_sql(num, den):
    return f"""WITH {SQL_SETS} SELECT lang, l_id, r_id, CAST(i AS INTEGER) AS n_common, CAST(u AS INTEGER) AS n_union,
      round(i / u, 6) AS sim, CAST(n_pairs AS BIGINT) AS n_pairs FROM sims WHERE i * {den} >= u * {num}"""


query("J2_set_join_09", _set_join_sql(9, 10))(_set_join(9, 10))
query("J2_set_join_05", _set_join_sql(1, 2))(_set_join(1, 2))


@query(
    "J2_set_join_rows",
    f"""WITH {SQL_PARITY}, t AS (SELECT doc_id, lang, label, len(bits) AS n, unnest(bits) AS tok FROM parity),
    o AS (SELECT a.lang, a.doc_id AS l_entity, b.doc_id AS r_entity, any_value(a.n) + any_value(b.n) - count(*) AS u, count(*) AS i
      FROM t a JOIN t b ON a.lang = b.lang AND a.tok = b.tok WHERE a.label = 1 AND b.label = 0 GROUP BY 1, 2, 3)
    SELECT lang, l_entity, r_entity, round(i / u, 6) AS sim FROM o WHERE i * 10 >= u * 9""",
)
def j2_rows(spark, sf):
    d = parity_docs(spark, sf)
    left, right = parity_sets(spark, sf)
    pairs = S.similar_sets(left, right, ["lang"], 9, 10)
    pos, neg = d.filter("label = 1"), d.filter("label = 0")
    lm, rm = (S.set_members(x, y, ["lang"], "doc_id", "bits") for x, y in ((pos, left), (neg, right)))
    return S.expand_members(pairs, lm, rm, ["lang"], "doc_id").withColumn("sim", F.round("sim", 6))


SQL_PAGE_ENTITIES = f"""pe AS (SELECT page_id, regexp_extract(url, '/([a-z][a-z])/', 1) AS dataset_name,
    regexp_extract(url, '^(https?)', 1) AS endpoint, CAST(page_id % 2 AS INTEGER) AS label, url AS repr,
    {SQL_WORDS.format('html')} AS bits,
    list_distinct(list_filter(regexp_split_to_array(html, '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '')) AS bits_chiral,
    {SQL_WORDS.format("regexp_extract(url, '//([^/]+)', 1)")} AS group_bits, regexp_extract(url, '//([^/]+)', 1) AS formula FROM pages)"""


def page_entities(spark, sf):
    p = table(spark, sf, "pages")
    host = F.regexp_extract("url", "//([^/]+)", 1)
    cased = F.array_distinct(F.filter(F.split("html", r"[^\p{L}\p{N}]+"), lambda x: x != ""))
    return p.select(
        "page_id",
        F.regexp_extract("url", "/([a-z][a-z])/", 1).alias("dataset_name"),
        F.regexp_extract("url", "^(https?)", 1).alias("endpoint"),
        (F.col("page_id") % 2).cast("int").alias("label"),
        F.col("url").alias("repr"),
        words(F.col("html")).alias("bits"),
        cased.alias("bits_chiral"),
        words(host).alias("group_bits"),
        host.alias("formula"),
    )


SQL_CONTRASTIVE = f"""{SQL_PAGE_ENTITIES}, sides AS (
  SELECT a.dataset_name, a.endpoint, a.repr AS left_repr, b.repr AS right_repr,
    len(list_intersect(a.bits, b.bits)) AS i1, len(a.bits) + len(b.bits) AS s1,
    len(list_intersect(a.bits_chiral, b.bits_chiral)) AS i2, len(a.bits_chiral) + len(b.bits_chiral) AS s2,
    len(list_intersect(a.group_bits, b.group_bits)) AS i3, len(a.group_bits) + len(b.group_bits) AS s3,
    levenshtein(a.repr, b.repr) AS d, greatest(length(a.repr), length(b.repr)) AS n, a.formula = b.formula AND a.formula <> '' AS same_formula
  FROM pe a JOIN pe b ON a.dataset_name = b.dataset_name AND a.endpoint = b.endpoint AND a.label = 1 AND b.label = 0),
flags AS (SELECT dataset_name, endpoint, left_repr, right_repr, same_formula,
    i1 > 0 AND i1 * 10 >= (s1 - i1) * 9 AS sub_ok, i2 > 0 AND i2 * 10 >= (s2 - i2) * 9 AS chiral_ok,
    i3 > 0 AND i3 * 10 >= (s3 - i3) * 9 AS group_ok, i3 > 0 AND i3 * 2 = s3 AS group_same, d * 10 <= n AS string_ok FROM sides),
contrastive AS (SELECT *, sub_ok OR group_ok OR string_ok AS is_fg, chiral_ok OR group_ok OR string_ok AS is_stereo,
    (chiral_ok OR group_ok OR string_ok) AND same_formula AS is_isomer FROM flags
  WHERE sub_ok OR chiral_ok OR group_ok OR string_ok)"""


@query(
    "J1_contrastive_pairs",
    f"""WITH {SQL_CONTRASTIVE} SELECT dataset_name, endpoint, left_repr, right_repr, sub_ok, chiral_ok, group_ok, string_ok,
      same_formula, is_fg, is_stereo, is_isomer FROM contrastive""",
)
def j1(spark, sf):
    return contrast.contrastive_pairs(page_entities(spark, sf)).drop("group_same")


@query(
    "J3_edit_join",
    """WITH p AS (SELECT page_id, regexp_extract(url, '^(https?)', 1) AS scheme, url FROM pages)
    SELECT a.scheme, a.page_id AS l_id, b.page_id AS r_id, CAST(levenshtein(a.url, b.url) AS INTEGER) AS distance,
      round(1 - levenshtein(a.url, b.url) / greatest(length(a.url), length(b.url)), 6) AS sim
    FROM p a JOIN p b ON a.scheme = b.scheme AND a.page_id % 2 = 1 AND b.page_id % 2 = 0
    WHERE levenshtein(a.url, b.url) * 10 <= greatest(length(a.url), length(b.url))""",
)
def j3(spark, sf):
    p = table(spark, sf, "pages").select(
        "page_id", F.regexp_extract("url", "^(https?)", 1).alias("scheme"), "url"
    )
    by = ["scheme"]
    pos, neg = (p.filter(F.col("page_id") % 2 == v) for v in (1, 0))
    left, right = (S.distinct_strings(d, by, "page_id", "url") for d in (pos, neg))
    pairs = S.similar_strings(left, right, by)
    lm, rm = (S.string_members(d, strings, by, "page_id", "url") for d, strings in ((pos, left), (neg, right)))
    rows = S.expand_members(pairs, lm, rm, by, "page_id", ["distance", "sim"])
    return rows.select("scheme", F.col("l_entity").alias("l_id"), F.col("r_entity").alias("r_id"), "distance", F.round("sim", 6).alias("sim"))


# A pair within k edits keeps all but k of the left text's disjoint pieces (4 characters, 8 from length 135 on).
# This engine's levenshtein counts bytes, so each letter beyond ASCII becomes a control character first.
SQL_LETTERS = "translate({0}, 'ÄÇÈÉÊÍÑÓÖÜßäçèéêíñóöü', " + " || ".join(f"chr({c})" for c in [*range(1, 9), *range(14, 27)]) + ")"
SQL_NEAR_TEXTS = f"""WITH t AS (SELECT lang, doc_id % 2 AS label, text, min(doc_id) AS id, count(*) AS m, length(text) AS n FROM documents
    WHERE text <> '' GROUP BY lang, doc_id % 2, text),
  lp AS (SELECT DISTINCT lang, id, n, CASE WHEN n < 135 THEN 4 ELSE 8 END AS g, unnest(CASE WHEN n < 9 THEN [text] WHEN n < 135
      THEN regexp_extract_all(text, '(?s).{{4}}') ELSE regexp_extract_all(text, '(?s).{{8}}') END) AS tok FROM t WHERE label = 1),
  rg AS (SELECT DISTINCT lang, id, n, tok FROM (SELECT lang, id, n, unnest(list_transform(range(1, n - 2), lambda i: substr(text, i, 4))) AS tok
      FROM t WHERE label = 0 AND n BETWEEN 9 AND 150
    UNION ALL SELECT lang, id, n, unnest(list_transform(range(1, n - 6), lambda i: substr(text, i, 8))) FROM t WHERE label = 0 AND n >= 120
    UNION ALL SELECT lang, id, n, text FROM t WHERE label = 0 AND n < 9)),
  np AS (SELECT lang, id, count(*) AS pieces FROM lp GROUP BY ALL),
  met AS (SELECT l.lang, l.id AS l_id, r.id AS r_id, count(*) AS hits, any_value(greatest(l.n, r.n)) AS longest FROM lp l JOIN rg r ON l.lang = r.lang AND l.tok = r.tok
    AND abs(l.n - r.n) * 10 <= greatest(l.n, r.n) GROUP BY ALL),
  cand AS (SELECT met.* FROM met JOIN np ON np.lang = met.lang AND np.id = met.l_id WHERE hits >= pieces - longest // 10),
  d AS (SELECT c.lang, l_id, r_id, longest, a.m * b.m AS n_pairs, CASE WHEN a.text = b.text THEN 0 ELSE levenshtein({SQL_LETTERS.format('a.text')}, {SQL_LETTERS.format('b.text')}) END AS distance
    FROM cand c JOIN t a ON a.lang = c.lang AND a.label = 1 AND a.id = l_id JOIN t b ON b.lang = c.lang AND b.label = 0 AND b.id = r_id)
  SELECT lang, l_id, r_id, CAST(distance AS INTEGER) AS distance, n_pairs FROM d WHERE distance * 10 <= longest"""


@query("J3_edit_join_texts", SQL_NEAR_TEXTS)
def j3_texts(spark, sf):
    """Whole document texts."""
    d = parity_docs(spark, sf)
    left, right = (
        S.distinct_strings(d.filter(F.col("label") == v), ["lang"], "doc_id", "text") for v in (1, 0)
    )
    return S.similar_strings(left, right, ["lang"]).select("lang", "l_id", "r_id", "distance", "n_pairs")


SQL_SELF = f"""{SQL_PARITY}, sets AS (
  SELECT lang, list_sort(bits) AS bits, min(doc_id) AS first_id, count(*) AS m, any_value(len(bits)) AS n
  FROM parity WHERE len(bits) > 0 GROUP BY lang, list_sort(bits)),
toks AS (SELECT lang, first_id, n, m, unnest(bits) AS tok FROM sets),
cross_sims AS (SELECT a.lang, a.first_id AS l_id, b.first_id AS r_id, any_value(a.m * b.m) AS n_pairs, count(*) AS i,
    any_value(a.n) + any_value(b.n) - count(*) AS u
  FROM toks a JOIN toks b ON a.lang = b.lang AND a.tok = b.tok AND a.first_id < b.first_id GROUP BY 1, 2, 3),
self_sims AS (SELECT * FROM cross_sims UNION ALL
  SELECT lang, first_id, first_id, m * (m - 1) // 2, n, n FROM sets WHERE m > 1)"""


def doc_sets(spark, sf):
    return S.distinct_sets(parity_docs(spark, sf), ["lang"], "doc_id", "bits")


@query(
    "J4_self_set_join",
    f"""WITH {SQL_SELF} SELECT lang, l_id, r_id, round(i / u, 6) AS sim, CAST(n_pairs AS BIGINT) AS n_pairs
    FROM self_sims WHERE i * 2 > u""",
)
def j4(spark, sf):
    return S.similar_sets_within(doc_sets(spark, sf), ["lang"], 1, 2, strict=True).select(
        "lang", "l_id", "r_id", F.round("sim", 6).alias("sim"), "n_pairs"
    )


@query(
    "J5_similarity_band",
    f"""WITH {SQL_SETS} SELECT lang, l_id, r_id, round(i / u, 6) AS sim FROM sims WHERE i * 10 >= u * 3 AND i * 10 <= u * 8""",
)
def j5(spark, sf):
    left, right = parity_sets(spark, sf)
    return S.similarity_band(left, right, ["lang"], (3, 10), (8, 10)).select(
        "lang", "l_id", "r_id", F.round("sim", 6).alias("sim")
    )


SQL_KEYS = """e AS (SELECT lang, CAST(doc_id % 2 AS INTEGER) AS label, text, md5(text) AS repr,
        CAST(len(string_split(string_split(text, chr(10))[1], ' ')) AS VARCHAR) AS formula FROM documents),
    pure AS (SELECT DISTINCT lang, label, repr, formula FROM e WHERE (lang, repr) IN (
        SELECT (lang, repr) FROM e GROUP BY lang, repr HAVING min(label) = max(label)))"""


def keyed_docs(spark, sf):
    d = parity_docs(spark, sf)
    first_line = F.split("text", "\n")[0]
    return d.select(
        "lang", "label", F.md5("text").alias("repr"), F.size(F.split(first_line, " ")).cast("string").alias("formula")
    )


@query(
    "J6_pairs_sharing_key",
    f"""WITH {SQL_KEYS} SELECT a.lang, a.formula, a.repr AS left_repr, b.repr AS right_repr FROM pure a JOIN pure b
      ON a.lang = b.lang AND a.formula = b.formula AND a.label = 1 AND b.label = 0""",
)
def j6(spark, sf):
    return J.pairs_sharing_key(keyed_docs(spark, sf), ["lang"], "formula")


@query(
    "J6_classes_sharing_key",
    f"""WITH {SQL_KEYS}, n AS (SELECT lang, formula, count(*) FILTER (label = 1) AS n_left, count(*) FILTER (label = 0) AS n_right FROM pure GROUP BY ALL)
    SELECT *, n_left * n_right AS n_pairs FROM n WHERE n_left > 0 AND n_right > 0""",
)
def j6_classes(spark, sf):
    return J.classes_sharing_key(keyed_docs(spark, sf), ["lang"], "formula")


@query(
    "J7_two_key_lookup",
    """WITH m AS (SELECT text, lower(trim(text)) AS canon, doc_id FROM documents WHERE doc_id % 3 = 0),
    r AS (SELECT text, max(doc_id) AS v FROM m GROUP BY 1), c AS (SELECT canon, max(doc_id) AS v FROM m GROUP BY 1)
    SELECT d.doc_id, coalesce('code' || r.v, 'code' || c.v, '') AS code FROM documents d
    LEFT JOIN r ON r.text = d.text LEFT JOIN c ON c.canon = lower(trim(d.text))""",
)
def j7(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "text", F.lower(F.trim("text")).alias("canon"))
    m = d.filter("doc_id % 3 = 0").select(
        F.col("text").alias("m_text"), F.col("canon").alias("m_canon"), "doc_id", F.concat(F.lit("code"), "doc_id").alias("code")
    )
    return J.two_key_lookup(d, "text", "canon", m, "m_text", "m_canon", "code", "doc_id").select("doc_id", "code")


@query(
    "J8_attach_both_sides",
    """SELECT e.event_id, a.p_name AS left_p_name, a.p_size AS left_p_size, b.p_name AS right_p_name, b.p_size AS right_p_size
    FROM events e LEFT JOIN part a ON a.p_partkey = e.event_id LEFT JOIN part b ON b.p_partkey = e.user_id""",
)
def j8(spark, sf):
    pairs = table(spark, sf, "events").select(
        "event_id", F.col("event_id").alias("left_id"), F.col("user_id").alias("right_id")
    )
    return J.attach_both_sides(
        pairs, table(spark, sf, "part"), "p_partkey", ["p_name", "p_size"], "left_id", "right_id"
    ).select("event_id", "left_p_name", "left_p_size", "right_p_name", "right_p_size")


@query(
    "J9_attach_features",
    f"""WITH {SQL_PART_PAIRS} SELECT l.l_orderkey, l.l_linenumber, sum(coalesce(len(list_distinct(e.words)), 0))::BIGINT AS n_names,
      sum(coalesce(len(e.cc), 0))::BIGINT AS n_centres, max(coalesce(e.p_size, 0)) AS p_size
    FROM lineitem l LEFT JOIN part_entities e ON e.p_partkey = l.l_partkey AND e.p_size % 3 <> 0 GROUP BY 1, 2""",
)
def j9(spark, sf):
    features = part_entities(spark, sf).filter("p_size % 3 <> 0").select(
        F.col("p_partkey").alias("l_partkey"), "fg_full", "chiral_centers", "p_size"
    )
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    empty = {
        "fg_full": F.create_map().cast("map<string,array<array<int>>>"),
        "chiral_centers": F.array().cast("array<struct<atom_idx:int,config:string>>"),
        "p_size": F.lit(0),
    }
    d = J.attach_features(li, features, "l_partkey", empty)
    return d.groupBy("l_orderkey", "l_linenumber").agg(
        F.sum(F.size("fg_full")).alias("n_names"),
        F.sum(F.size("chiral_centers")).alias("n_centres"),
        F.max("p_size").alias("p_size"),
    )


SQL_STEREO = f"""{SQL_PART_PAIRS}, st AS (SELECT *,
  len(l_c) <> len(r_c) OR len(list_filter(l_c, lambda x: x.config = 'R')) <> len(list_filter(r_c, lambda x: x.config = 'R'))
    OR len(list_filter(l_c, lambda x: x.config = 'S')) <> len(list_filter(r_c, lambda x: x.config = 'S')) AS c_loose,
  len(l_b) <> len(r_b) OR len(list_filter(l_b, lambda x: x.geometry = 'E')) <> len(list_filter(r_b, lambda x: x.geometry = 'E'))
    OR len(list_filter(l_b, lambda x: x.geometry = 'Z')) <> len(list_filter(r_b, lambda x: x.geometry = 'Z')) AS b_loose,
  len(l_c) > 0 AND len(r_c) > 0 AND list_sort(list_transform(l_c, lambda x: x.config)) <> list_sort(list_transform(r_c, lambda x: x.config)) AS c_strict,
  len(l_b) > 0 AND len(r_b) > 0 AND list_sort(list_transform(l_b, lambda x: x.geometry)) <> list_sort(list_transform(r_b, lambda x: x.geometry)) AS b_strict,
  len(list_filter(l_names, lambda x: NOT list_contains(r_names, x))) + len(list_filter(r_names, lambda x: NOT list_contains(l_names, x))) AS n_fg
  FROM part_pairs)"""


@query(
    "J10_full_merge",
    f"""WITH {SQL_STEREO}, f AS (SELECT dataset_name, endpoint, pair_id, CAST(n_fg AS INTEGER) AS n_fg_diff, l_size AS sim FROM st WHERE n_fg > 0),
    s AS (SELECT dataset_name, endpoint, pair_id, CASE WHEN c_loose AND b_loose THEN 'both' WHEN c_loose THEN 'chiral_only' ELSE 'ez_only' END AS stereo_diff_type_loose,
      r_size AS sim FROM st WHERE c_loose OR b_loose)
    SELECT coalesce(f.dataset_name, s.dataset_name) AS dataset_name, coalesce(f.endpoint, s.endpoint) AS endpoint, coalesce(f.pair_id, s.pair_id) AS pair_id,
      n_fg_diff, stereo_diff_type_loose, coalesce(f.sim, s.sim) AS sim
    FROM f FULL OUTER JOIN s ON f.pair_id = s.pair_id AND f.dataset_name = s.dataset_name AND f.endpoint = s.endpoint""",
)
def j10(spark, sf):
    p = part_pairs(spark, sf)
    keys = ["dataset_name", "endpoint", "pair_id"]
    fg = rowdiff.feature_name_diff(p).filter("has_fg_diff").select(*keys, "n_fg_diff", F.col("left_p_size").alias("sim"))
    st = rowdiff.loose_stereo_diff(p).filter("stereo_diff_type_loose <> ''").select(
        *keys, "stereo_diff_type_loose", F.col("right_p_size").alias("sim")
    )
    return J.full_merge(fg, st, keys)


@query(
    "J11_move_flagged",
    """WITH many AS (SELECT l_returnflag, l_partkey FROM lineitem WHERE l_orderkey % 4 = 0 GROUP BY ALL HAVING count(DISTINCT l_suppkey) >= 2),
    t AS (SELECT CASE WHEN l_orderkey % 4 = 0 AND (l_returnflag, l_partkey) IN (SELECT (l_returnflag, l_partkey) FROM many) THEN 'train'
      WHEN l_orderkey % 4 = 0 THEN 'test' ELSE 'train' END AS part, l_returnflag, l_orderkey FROM lineitem)
    SELECT part, l_returnflag, count(*) AS n, sum(l_orderkey)::BIGINT AS key_sum FROM t GROUP BY ALL""",
)
def j11(spark, sf):
    li = table(spark, sf, "lineitem").select("l_returnflag", "l_partkey", "l_suppkey", "l_orderkey")
    test, train = li.filter("l_orderkey % 4 = 0"), li.filter("l_orderkey % 4 <> 0")
    many = test.groupBy("l_returnflag", "l_partkey").agg(F.countDistinct("l_suppkey").alias("k")).filter("k >= 2")
    kept, grown = J.move_flagged(test, train, many, ["l_returnflag", "l_partkey"])
    both = kept.withColumn("part", F.lit("test")).unionByName(grown.withColumn("part", F.lit("train")))
    return both.groupBy("part", "l_returnflag").agg(F.count(F.lit(1)).alias("n"), F.sum("l_orderkey").alias("key_sum"))


@query("J12_loose_only", f"WITH {SQL_STEREO} SELECT pair_id FROM st WHERE (c_loose OR b_loose) AND NOT (c_strict OR b_strict)")
def j12(spark, sf):
    p = part_pairs(spark, sf)
    loose = rowdiff.loose_stereo_diff(p).filter("stereo_diff_type_loose <> ''").select("pair_id")
    strict = rowdiff.strict_stereo_diff(p).filter("stereo_diff_type <> ''").select("pair_id")
    return J.only_in_first(loose, strict, ["pair_id"])


# --- prediction alignment: every three turns of a conversation are the outputs of three tasks ------
SQL_TASKS = f"""{SQL_PREDICTIONS}, tasks AS (SELECT conv_id * 100 + turn // 3 AS id, CAST(turn % 3 AS INTEGER) AS turn, dataset_name,
    CASE WHEN turn % 3 = 2 AND conv_id % 4 = 0 THEN NULL ELSE endpoint END AS endpoint, model, step,
    CASE WHEN length(pred) % 7 = 0 THEN NULL ELSE CAST(length(pred) % 2 AS DOUBLE) END AS em,
    CAST(length(gold) % 3 AS DOUBLE) / 2 AS bleu, pred, gold FROM predictions)"""


def task_frames(spark, sf):
    p = predictions(spark, sf)
    n = F.length("pred")
    t = p.select(
        (F.col("conv_id") * 100 + F.floor(F.col("turn") / 3)).alias("id"),
        (F.col("turn") % 3).alias("turn"),
        "dataset_name",
        F.when(~((F.col("turn") % 3 == 2) & (F.col("conv_id") % 4 == 0)), F.col("endpoint")).alias("endpoint"),
        "model",
        "step",
        F.when(n % 7 != 0, (n % 2).cast("double")).alias("em"),
        ((F.length("gold") % 3).cast("double") / 2).alias("bleu"),
        "pred",
        "gold",
    )
    return [t.filter(F.col("turn") == i) for i in range(3)]


def aligned_three(spark, sf):
    a, b, c = task_frames(spark, sf)
    return J.align([("t1", a), ("t2", b), ("t3", c)], "id", ["dataset_name", "endpoint"], ["em", "bleu"])


SQL_ALIGNED = f"""{SQL_TASKS}, aligned AS (SELECT a.id, a.dataset_name, a.endpoint, a.model, a.em AS t1_em, a.bleu AS t1_bleu, b.em AS t2_em, b.bleu AS t2_bleu,
    c.em AS t3_em, c.bleu AS t3_bleu, CASE WHEN a.endpoint IS DISTINCT FROM b.endpoint OR a.endpoint IS DISTINCT FROM c.endpoint THEN 1 ELSE 0 END AS meta_mismatch
  FROM tasks a JOIN tasks b USING (id) JOIN tasks c USING (id) WHERE a.turn = 0 AND b.turn = 1 AND c.turn = 2)"""


@query("J13_align_three", f"WITH {SQL_ALIGNED} SELECT id, dataset_name, endpoint, t1_em, t1_bleu, t2_em, t2_bleu, t3_em, t3_bleu, meta_mismatch FROM aligned")
def j13(spark, sf):
    return aligned_three(spark, sf)


@query(
    "J14_align_two",
    f"""WITH {SQL_TASKS} SELECT a.id, a.dataset_name, a.endpoint, a.em AS direct_em, a.bleu AS direct_bleu, b.em AS chained_em, b.bleu AS chained_bleu,
      CASE WHEN a.endpoint IS DISTINCT FROM b.endpoint THEN 1 ELSE 0 END AS meta_mismatch
    FROM tasks a JOIN tasks b USING (id) WHERE a.turn = 0 AND b.turn = 2""",
)
def j14(spark, sf):
    a, _, c = task_frames(spark, sf)
    return J.align([("direct", a), ("chained", c)], "id", ["dataset_name", "endpoint"], ["em", "bleu"])


@query(
    "J15_attach_gold",
    f"""WITH {SQL_PREDICTIONS} SELECT p.id, coalesce(c.text, p.gold) AS gold FROM predictions p
    LEFT JOIN conversations c ON c.conv_id * 100 + c.turn = p.id AND c.role = 'user'""",
)
def j15(spark, sf):
    gold = table(spark, sf, "conversations").filter("role = 'user'").select(
        (F.col("conv_id") * 100 + F.col("turn")).alias("id"), F.col("text").alias("gold")
    )
    return J.attach_gold(predictions(spark, sf), gold).select("id", "gold")


@query(
    "J16_source_row",
    """SELECT e.event_id, e.event_id * 2 AS source_index, d.lang, d.n_chars FROM events e LEFT JOIN documents d ON d.doc_id = e.event_id * 2""",
)
def j16(spark, sf):
    preds = table(spark, sf, "events").select("event_id", (F.col("event_id") * 2).alias("source_index"))
    rows = table(spark, sf, "documents").select(F.col("doc_id").alias("source_index"), "lang", "n_chars")
    return J.attach_source_row(preds, rows, ["lang", "n_chars"])


@query(
    "J17_chained_inputs",
    f"""WITH {SQL_TASKS}, s AS (SELECT id, turn, CASE WHEN length(pred) % 5 = 0 OR trim(pred) = '' THEN gold ELSE trim(pred) END AS filled FROM tasks)
    SELECT a.id, a.filled AS stage2_input, a.filled || ' || ' || b.filled AS stage3_input FROM s a JOIN s b USING (id)
    WHERE a.turn = 0 AND b.turn = 1 AND a.id IN (SELECT doc_id FROM labels)""",
)
def j17(spark, sf):
    a, b, _ = task_frames(spark, sf)
    blank = F.when(F.length("pred") % 5 == 0, "  ").otherwise(F.col("pred"))
    anchors = table(spark, sf, "labels").select(F.col("doc_id").alias("id"))
    return J.chained_inputs(a.withColumn("pred", blank), b.withColumn("pred", blank), "id", anchors)


@query(
    "J19_similar_to_row",
    f"""WITH {SQL_TURNS}, b AS (SELECT source_index, {SQL_WORDS.format('left_repr')} AS l, {SQL_WORDS.format('right_repr')} AS r FROM turns),
    ref AS (SELECT l AS rl, r AS rr FROM b WHERE source_index = (SELECT min(source_index) FROM b)),
    s AS (SELECT source_index, len(list_intersect(l, rl)) / (len(l) + len(rl) - len(list_intersect(l, rl))) AS sim_left,
        len(list_intersect(r, rr)) / (len(r) + len(rr) - len(list_intersect(r, rr))) AS sim_right
      FROM b, ref WHERE source_index <> (SELECT min(source_index) FROM b) AND abs(len(l) - len(rl)) <= 40 AND abs(len(r) - len(rr)) <= 40)
    SELECT source_index, round(sim_left, 6) AS sim_left, round(sim_right, 6) AS sim_right, round((sim_left + sim_right) / 2, 6) AS score
    FROM s ORDER BY (sim_left + sim_right) / 2 DESC, source_index LIMIT 20""",
)
def j19(spark, sf):
    t = turns(spark, sf).select(
        "source_index", words(F.col("left_repr")).alias("l"), words(F.col("right_repr")).alias("r")
    )
    t = t.withColumns({"ln": F.size("l"), "rn": F.size("r")})
    first = t.agg(F.min("source_index")).first()[0]
    out = J.similar_to_row(t, "source_index", first, "l", "r", "ln", "rn", 40, 20)
    return out.select("source_index", *[F.round(c, 6).alias(c) for c in ("sim_left", "sim_right", "score")])
