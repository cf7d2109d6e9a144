"""String and set functions, each over a whole table."""

from __future__ import annotations

from pyspark.sql import functions as F

from pairloom.functions import parsing, sets, strings
from pairloom.plans.frames import SQL_PREDICTIONS, SQL_TURNS, SQL_WORDS, predictions, turns
from pairloom.plans.registry import query, table

SQL_TOKENS = "list_filter(string_split(replace(trim(coalesce({0}, '')), ' ', ''), '.'), lambda x: x <> '')"
SQL_CHARS = """{name} AS (SELECT id, c, count(*) AS n FROM (
    SELECT {id} AS id, unnest(string_split(replace(trim({text}), ' ', ''), '')) AS c FROM {src}) WHERE c <> '' GROUP BY ALL)"""


def sql_char_precision(src: str, key: str, gold: str, pred: str) -> str:
    """CTE ``char_precision(id, value)`` by counting characters row by row."""
    g = SQL_CHARS.format(name="gc", id=key, text=gold, src=src)
    p = SQL_CHARS.format(name="pc", id=key, text=pred, src=src)
    return f"""{g}, {p},
    pt AS (SELECT id, sum(n) AS total FROM pc GROUP BY id),
    ov AS (SELECT pc.id, sum(least(pc.n, gc.n)) AS hits FROM pc JOIN gc ON gc.id = pc.id AND gc.c = pc.c GROUP BY pc.id),
    char_precision AS (SELECT s.{key} AS id, CASE WHEN pt.total IS NULL OR replace(trim({gold}), ' ', '') = '' THEN 0.0
       ELSE coalesce(hits, 0) / total END AS value
       FROM {src} s LEFT JOIN pt ON pt.id = s.{key} LEFT JOIN ov ON ov.id = s.{key})"""


@query(
    "F1_edit_distance",
    """SELECT a.page_id, CAST(levenshtein(a.url, b.url) AS INTEGER) AS distance,
      round(1 - levenshtein(a.url, b.url) / greatest(length(a.url), length(b.url), 1), 6) AS sim
    FROM pages a JOIN pages b ON b.page_id = a.page_id + 1""",
)
def f1(spark, sf):
    p = table(spark, sf, "pages").select("page_id", "url")
    nxt = p.select((F.col("page_id") - 1).alias("page_id"), F.col("url").alias("next_url"))
    a, b = F.col("url"), F.col("next_url")
    return p.join(nxt, "page_id").select(
        "page_id", F.levenshtein(a, b).alias("distance"), F.round(strings.edit_similarity(a, b), 6).alias("sim")
    )


@query(
    "F2_char_precision",
    f"WITH {SQL_PREDICTIONS}, {sql_char_precision('predictions', 'id', 'gold', 'pred')} SELECT id, round(value, 6) AS char_precision FROM char_precision",
)
def f2(spark, sf):
    return predictions(spark, sf).select(
        "id", F.round(strings.char_precision(F.col("gold"), F.col("pred")), 6).alias("char_precision")
    )


@query(
    "F3_code_tokens",
    f"SELECT doc_id, CAST(len(t) AS INTEGER) AS n_tokens, array_to_string(t, '|') AS tokens FROM (SELECT doc_id, {SQL_TOKENS.format('text')} AS t FROM documents)",
)
def f3(spark, sf):
    t = strings.code_tokens(F.col("text"))
    return table(spark, sf, "documents").select(
        "doc_id", F.size(t).alias("n_tokens"), F.array_join(t, "|").alias("tokens")
    )


@query(
    "F4_multiset_match",
    f"""WITH d AS (SELECT doc_id, text, array_to_string(list_reverse(string_split(text, '.')), '.') AS other FROM documents)
    SELECT doc_id, CASE WHEN trim(text) <> '' AND list_sort({SQL_TOKENS.format('text')}) = list_sort({SQL_TOKENS.format("CASE WHEN doc_id % 3 = 0 THEN other || '.a' ELSE other END")})
      THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS em FROM d""",
)
def f4(spark, sf):
    other = F.array_join(F.reverse(F.split("text", "[.]")), ".")
    pred = F.when(F.col("doc_id") % 3 == 0, F.concat(other, F.lit(".a"))).otherwise(other)
    return table(spark, sf, "documents").select("doc_id", strings.same_multiset(F.col("text"), pred).alias("em"))


SQL_PRF = """prf AS (SELECT id, CASE WHEN ng = 0 AND np = 0 THEN 1.0 WHEN ng = 0 OR np = 0 THEN 0.0 ELSE tp / np END AS p,
    CASE WHEN ng = 0 THEN 1.0 WHEN np = 0 THEN 0.0 ELSE tp / ng END AS r,
    CASE WHEN ng = 0 AND np = 0 THEN 1.0 WHEN ng = 0 OR np = 0 OR tp = 0 THEN 0.0 ELSE 2.0 * tp / (ng + np) END AS f
  FROM (SELECT id, len(g) AS ng, len(p) AS np, len(list_intersect(g, p)) AS tp FROM
    (SELECT {key} AS id, list_distinct({gold}) AS g, list_distinct({pred}) AS p FROM {src})))"""


@query(
    "F5_set_precision_recall",
    f"""WITH {SQL_PREDICTIONS}, {SQL_PRF.format(key='id', src='predictions', gold=SQL_TOKENS.format("replace(gold, 'e', '.')"), pred=SQL_TOKENS.format("CASE WHEN turn = 2 THEN '' ELSE replace(pred, 'e', '.') END"))}
    SELECT id, round(p, 6)::DOUBLE AS precision, round(r, 6)::DOUBLE AS recall, round(f, 6)::DOUBLE AS f1 FROM prf""",
)
def f5(spark, sf):
    gold = F.translate("gold", "e", ".")
    pred = F.when(F.col("turn") == 2, "").otherwise(F.translate("pred", "e", "."))
    m = strings.set_precision_recall_f1(gold, pred)
    return predictions(spark, sf).select("id", *[F.round(c, 6).alias(n) for n, c in m.items()])


@query(
    "F6_tanimoto_dice",
    f"""WITH {SQL_TURNS}, s AS (SELECT source_index, {SQL_WORDS.format('left_repr')} AS a, {SQL_WORDS.format('right_repr')} AS b FROM turns),
    n AS (SELECT source_index, len(a) AS na, len(b) AS nb, len(list_intersect(a, b)) AS i FROM s)
    SELECT source_index, CASE WHEN na + nb = 0 THEN 0 ELSE round(i / (na + nb - i), 6) END AS tanimoto,
      CASE WHEN na + nb = 0 THEN 0 ELSE round(2.0 * i / (na + nb), 6)::DOUBLE END AS dice FROM n""",
)
def f6(spark, sf):
    a, b = sets.words(F.col("left_repr")), sets.words(F.col("right_repr"))
    return turns(spark, sf).select(
        "source_index", F.round(sets.tanimoto(a, b), 6).alias("tanimoto"), F.round(sets.dice(a, b), 6).alias("dice")
    )


# stored predictions in the shapes a run leaves behind: plain text, an object, an object in an object
_SHAPES = """CASE event_id % 4 WHEN 0 THEN concat(' ', event_type, ' ') WHEN 1 THEN concat('{"answer": "', event_type, '"}')
 WHEN 2 THEN concat('{"answer": "{\\\\"answer\\\\": \\\\"in_', event_type, '\\\\"}", "x": 1}') ELSE concat('{broken ', event_type) END"""


@query(
    "F7_answer_extraction",
    """SELECT event_id, CASE event_id % 4 WHEN 0 THEN event_type WHEN 1 THEN event_type WHEN 2 THEN 'in_' || event_type
      ELSE '{broken ' || event_type END AS answer FROM events""",
)
def f7(spark, sf):
    shaped = table(spark, sf, "events").select("event_id", F.expr(_SHAPES).alias("pred"))
    return shaped.select("event_id", parsing.answer_of(F.col("pred")).alias("answer"))


@query(
    "F8_lenient_json",
    """SELECT event_id, CASE event_id % 3 WHEN 0 THEN props WHEN 1 THEN props ELSE NULL END AS object FROM events""",
)
def f8(spark, sf):
    reply = F.expr(
        "CASE event_id % 3 WHEN 0 THEN concat('  ', props) WHEN 1 THEN concat('Sure: ', props, ' done') "
        "ELSE concat('{', event_type, ' no object') END"
    )
    e = table(spark, sf, "events").select("event_id", reply.alias("reply"))
    return e.select("event_id", parsing.json_object_in(F.col("reply")).alias("object"))


@query(
    "F9_json_field",
    """SELECT event_id, regexp_extract(props, '"k": ([0-9]+)', 1) AS k, '' AS absent FROM events""",
)
def f9(spark, sf):
    props = F.col("props")
    return table(spark, sf, "events").select(
        "event_id", parsing.json_field(props, "k").alias("k"), parsing.json_field(props, "zz").alias("absent")
    )


@query(
    "F10_joined_parts",
    """SELECT p_partkey, concat_ws('.', nullif(trim(p_name), ''), CASE WHEN p_size % 3 <> 0 THEN p_brand END, p_type) AS joined FROM part""",
)
def f10(spark, sf):
    brand = F.when(F.col("p_size") % 3 == 0, "  ").otherwise(F.col("p_brand"))
    return table(spark, sf, "part").select(
        "p_partkey", strings.joined_parts(F.col("p_name"), brand, F.col("p_type")).alias("joined")
    )


@query(
    "F11_exact_match",
    """SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 1 ELSE CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END END::INTEGER AS correct FROM orders""",
)
def f11(spark, sf):
    pred = F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit(" "), "o_orderstatus", F.lit(" "))).otherwise("F")
    return table(spark, sf, "orders").select(
        "o_orderkey", strings.exact_match(F.col("o_orderstatus"), pred).alias("correct")
    )


@query(
    "F12_pair_score",
    """SELECT l_orderkey, l_linenumber, round(sum(0.50*l_discount + 0.35*l_tax + 0.15*l_discount - 0.10*l_quantity - 0.05*l_tax), 6)::DOUBLE AS score,
      round(sum(0.55*l_discount + 0.30*l_tax + 0.15*l_discount - 0.12*l_quantity - 0.06*l_tax - 0.03*l_linenumber), 6)::DOUBLE AS relaxed
    FROM lineitem GROUP BY ALL""",
)
def f12(spark, sf):
    from pairloom.operators.ranking import pair_score, relaxed_score

    li = table(spark, sf, "lineitem")
    s, a, b, d, e = (F.col(c) for c in ("l_discount", "l_tax", "l_discount", "l_quantity", "l_tax"))
    return li.groupBy("l_orderkey", "l_linenumber").agg(
        F.round(F.sum(pair_score(s, a, b, d, e)), 6).alias("score"),
        F.round(F.sum(relaxed_score(s, a, b, d, e, F.col("l_linenumber"))), 6).alias("relaxed"),
    )


@query(
    "F13_display",
    """SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN '' ELSE printf('%.6g', sqrt(o_totalprice)) END AS shown FROM orders""",
)
def f13(spark, sf):
    price = F.when(F.col("o_orderkey") % 4 != 0, F.sqrt("o_totalprice"))
    return table(spark, sf, "orders").select("o_orderkey", strings.display_number(price).alias("shown"))
