"""Evaluation of predictions: a page's address is the prediction, the next page's address is gold."""

from __future__ import annotations

import sys

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import functions as F

from pairloom.functions.parsing import json_field
from pairloom.functions.sets import shingles, words
from pairloom.operators import features as E
from pairloom.operators import metrics as M
from pairloom.operators.aggregates import reason_histogram
from pairloom.plans.frames import SQL_FRAGMENTS, SQL_TURNS, SQL_WORDS, turns
from pairloom.plans.part_pairs import SQL_CASE_PAIRS, case_pairs
from pairloom.plans.q_functions import SQL_PRF, SQL_TOKENS, sql_char_precision
from pairloom.plans.registry import query, table


cloudpickle.register_pickle_by_value(sys.modules[__name__])


def decoded_table(spark, sf):
    """Built-in encoder of addresses, run once per distinct one."""
    codes = E.distinct_values(
        table(spark, sf, "pages").select("url", F.concat(F.lit("www."), "url").alias("full")), ["url", "full"], "code"
    )
    n, c = F.length("code"), F.col("code")
    decoded = F.when(n % 7 != 0, c)
    return codes.select(
        "code",
        decoded.alias("decoded"),
        F.when((n % 7 != 0) & (n % 5 != 0), F.regexp_extract(c, "//(?:www[.]|m[.]|blog[.])?([^/]+)", 1)).alias("canon"),
        shingles(c, 3).alias("bits_rdk"),
        F.array_distinct(F.filter(F.split(c, ""), lambda x: x != "")).alias("bits_maccs"),
        words(c).alias("bits_morgan"),
        F.when(n % 7 == 0, "length").when(n % 5 == 0, "parse").alias("error"),
    )


def evals(spark, sf):
    p = table(spark, sf, "pages").select("page_id", "url")
    nxt = p.select((F.col("page_id") - 1).alias("page_id"), F.col("url").alias("gold"))
    scheme = F.regexp_extract("url", "^(https?)", 1)
    return p.join(nxt, "page_id").select(
        F.col("page_id").alias("id"),
        F.when(F.col("page_id") % 11 == 0, "").otherwise(F.col("url")).alias("pred"),
        "gold",
        F.when(F.col("page_id") % 13 != 0, F.col("gold")).alias("gold_repr"),
        F.lit("www").alias("common"),
        F.concat(F.lit("m"), (F.col("page_id") % 3).cast("string")).alias("model"),
        scheme.alias("step"),
    )


_BITS3 = "list_distinct(list_transform(range(1, length({0}) - 1), lambda i: substr({0}, i, 3)))"
SQL_EVALS = f"""codes AS (SELECT url AS code FROM pages UNION SELECT 'www.' || url FROM pages),
decoded AS (SELECT code, CASE WHEN length(code) % 7 <> 0 THEN code END AS decoded,
  CASE WHEN length(code) % 7 <> 0 AND length(code) % 5 <> 0 THEN regexp_extract(code, '//(?:www[.]|m[.]|blog[.])?([^/]+)', 1) END AS canon,
  {_BITS3.format('code')} AS b1, list_distinct(string_split(code, '')) AS b2, {SQL_WORDS.format('code')} AS b3,
  CASE WHEN length(code) % 7 = 0 THEN 'length' WHEN length(code) % 5 = 0 THEN 'parse' END AS error FROM codes),
evals AS (SELECT p.page_id AS id, CASE WHEN p.page_id % 11 = 0 THEN '' ELSE p.url END AS pred, g.url AS gold, CASE WHEN p.page_id % 13 <> 0 THEN g.url END AS gold_repr,
  'm' || (p.page_id % 3) AS model, regexp_extract(p.url, '^(https?)', 1) AS step FROM pages p JOIN pages g ON g.page_id = p.page_id + 1)"""


def sql_sim(a, b):
    return f"len(list_intersect({a}, {b})) / (len({a}) + len({b}) - len(list_intersect({a}, {b})))"


SQL_FRAG = f"""{SQL_EVALS}, {sql_char_precision('evals', 'id', 'gold', 'pred')}, {SQL_PRF.format(key='id', src='evals', gold=SQL_TOKENS.format('gold'), pred=SQL_TOKENS.format('pred'))},
frag AS (SELECT e.id, CASE WHEN gold <> '' AND list_sort({SQL_TOKENS.format('gold')}) = list_sort({SQL_TOKENS.format('pred')}) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS fragment_em,
  CASE WHEN gold <> '' AND gold = pred THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS text_em,
  round(c.value, 6)::DOUBLE AS fragment_bleu1, round(p, 6)::DOUBLE AS fragment_precision, round(r, 6)::DOUBLE AS fragment_recall, round(f, 6)::DOUBLE AS fragment_f1
  FROM evals e JOIN char_precision c USING (id) JOIN prf USING (id))"""
FRAG = ("fragment_em", "fragment_bleu1", "fragment_precision", "fragment_recall", "fragment_f1")
SQL_ENTITY = f"""entity AS (SELECT e.id, CASE WHEN usable AND p.canon IS NOT NULL AND g.canon IS NOT NULL THEN (p.canon = g.canon)::INT::DOUBLE END AS entity_em,
  CASE WHEN usable AND p.canon IS NOT NULL AND g.canon IS NOT NULL THEN round({sql_sim('p.b3', 'g.b3')}, 6) END AS entity_sim, CASE WHEN usable THEN (p.canon IS NOT NULL)::INT::DOUBLE END AS entity_validity
  FROM (SELECT *, gold_repr IS NOT NULL AND pred <> '' AS has FROM evals) e LEFT JOIN decoded p ON p.code = CASE WHEN e.has THEN 'www.' || e.pred END
  LEFT JOIN decoded g ON g.code = e.gold_repr, LATERAL (SELECT e.has AND p.decoded IS NOT NULL AS usable))"""
ENTITY = ("entity_em", "entity_sim", "entity_validity")
SQL_STRING = f"""strings AS (SELECT e.id, coalesce((p.canon = g.canon)::INT, 0)::DOUBLE AS exact_match, round(c.value, 6)::DOUBLE AS bleu, levenshtein(e.gold, e.pred)::DOUBLE AS levenshtein,
  CASE WHEN p.canon IS NOT NULL AND g.canon IS NOT NULL THEN round({sql_sim('p.b1', 'g.b1')}, 6) ELSE 0 END AS rdk_fts, CASE WHEN p.canon IS NOT NULL AND g.canon IS NOT NULL THEN round({sql_sim('p.b2', 'g.b2')}, 6) ELSE 0 END AS maccs_fts,
  CASE WHEN p.canon IS NOT NULL AND g.canon IS NOT NULL THEN round({sql_sim('p.b3', 'g.b3')}, 6) ELSE 0 END AS morgan_fts, (p.canon IS NOT NULL)::INT::DOUBLE AS validity
  FROM evals e JOIN char_precision c USING (id) LEFT JOIN decoded p ON p.code = e.pred LEFT JOIN decoded g ON g.code = e.gold)"""
STRING = ("exact_match", "bleu", "levenshtein", "rdk_fts", "maccs_fts", "morgan_fts", "validity")


def _rounded(df, names):
    return df.select("id", *[F.round(c, 6).alias(c) for c in names])


@query("M1_fragment_identification", f"WITH {SQL_FRAG} SELECT id, {', '.join(FRAG)} FROM frag")
def m1(spark, sf):
    m = M.fragment_metrics(F.col("gold"), F.col("pred"))
    return _rounded(evals(spark, sf).withColumns(m), FRAG)


@query("M2_fragment_generation", f"WITH {SQL_FRAG}, {SQL_ENTITY} SELECT id, {', '.join(FRAG + ENTITY)} FROM frag JOIN entity USING (id)")
def m2(spark, sf):
    return _rounded(M.generated_fragment_frame(evals(spark, sf), decoded_table(spark, sf)), FRAG + ENTITY)


@query("M3_string_generation", f"WITH {SQL_FRAG}, {SQL_STRING} SELECT id, {', '.join(STRING)} FROM strings")
def m3(spark, sf):
    return _rounded(M.generated_string_frame(evals(spark, sf), decoded_table(spark, sf)), STRING)


SQL_CODE = f"""canons AS (SELECT e.id, coalesce(p.canon, '') AS pc, coalesce(g.canon, '') AS gc_, p.canon IS NOT NULL AND g.canon IS NOT NULL AS ok FROM evals e LEFT JOIN decoded p ON p.code = e.pred LEFT JOIN decoded g ON g.code = e.gold),
{sql_char_precision('canons', 'id', 'gc_', 'pc').replace('gc AS', 'gcc AS').replace('pc AS (SELECT id, c,', 'pcc AS (SELECT id, c,').replace('FROM pc GROUP', 'FROM pcc GROUP').replace('FROM pc JOIN gc ON gc.id = pc.id AND gc.c = pc.c', 'FROM pcc pc JOIN gcc gc ON gc.id = pc.id AND gc.c = pc.c').replace('pt AS', 'ptc AS').replace('JOIN pt ON', 'JOIN ptc pt ON').replace('ov AS', 'ovc AS').replace('JOIN ov ON', 'JOIN ovc ov ON').replace('char_precision AS', 'canon_precision AS')},
code_m AS (SELECT e.id, (trim(e.gold) = trim(e.pred))::INT::DOUBLE AS code_em, s.exact_match, CASE WHEN ok THEN round(cp.value, 6) ELSE 0 END AS bleu,
  CASE WHEN ok THEN levenshtein(gc_, pc)::DOUBLE ELSE 0 END AS levenshtein, s.rdk_fts, s.maccs_fts, s.morgan_fts, s.validity
  FROM evals e JOIN strings s USING (id) JOIN canons USING (id) JOIN canon_precision cp USING (id))"""
CODE = ("code_em", *STRING)


@query("M4_code_generation", f"WITH {SQL_FRAG}, {SQL_STRING}, {SQL_CODE} SELECT id, {', '.join(CODE)} FROM code_m")
def m4(spark, sf):
    return _rounded(M.generated_code_frame(evals(spark, sf), decoded_table(spark, sf)), CODE)


def stepwise(spark, sf):
    """The model's reply is one JSON object with two steps and an answer."""
    e = evals(spark, sf)
    reply = F.to_json(F.struct(F.col("pred").alias("step1"), F.col("pred").alias("step2"), F.col("pred").alias("answer")))
    d = e.withColumn("reply", reply)
    return d.select(
        "id",
        "gold",
        json_field(F.col("reply"), "answer").alias("pred"),
        F.col("gold").alias("gold_step1"),
        json_field(F.col("reply"), "step1").alias("pred_step1"),
        F.col("gold").alias("gold_step2"),
        json_field(F.col("reply"), "step2").alias("pred_step2"),
        "common",
        "gold_repr",
    )


_STEP_SQL = f"{', '.join(f'{c} AS step1_{c}' for c in FRAG)}, {', '.join(f'{c} AS step2_{c}' for c in FRAG + ENTITY)}"
_STEPS = tuple(f"step1_{c}" for c in FRAG) + tuple(f"step2_{c}" for c in FRAG + ENTITY)


@query("M5_stepwise_string", f"WITH {SQL_FRAG}, {SQL_ENTITY}, {SQL_STRING} SELECT id, {_STEP_SQL}, {', '.join(STRING)} FROM frag JOIN entity USING (id) JOIN strings USING (id)")
def m5(spark, sf):
    return _rounded(M.stepwise_frame(stepwise(spark, sf), decoded_table(spark, sf)), _STEPS + STRING)


@query("M5_stepwise_code", f"WITH {SQL_FRAG}, {SQL_ENTITY}, {SQL_STRING}, {SQL_CODE} SELECT id, {_STEP_SQL}, {', '.join(CODE)} FROM frag JOIN entity USING (id) JOIN code_m USING (id)")
def m5_code(spark, sf):
    return _rounded(M.stepwise_frame(stepwise(spark, sf), decoded_table(spark, sf), "code"), _STEPS + CODE)


@query(
    "M6_string_to_code",
    f"""WITH {SQL_FRAG} SELECT e.id, text_em AS em, fragment_bleu1 AS bleu1, (p.canon IS NOT NULL)::INT::DOUBLE AS validity, levenshtein(e.gold, e.pred)::DOUBLE AS lev,
      round(1 - levenshtein(e.gold, e.pred) / greatest(length(e.gold), length(e.pred), 1), 6) AS lev_norm,
      CASE WHEN p.canon IS NOT NULL AND g.canon IS NOT NULL THEN (p.canon = g.canon)::INT::DOUBLE END AS entity_em,
      CASE WHEN p.canon IS NOT NULL AND g.canon IS NOT NULL THEN round({sql_sim('p.b3', 'g.b3')}, 6) END AS entity_sim,
      CASE WHEN e.gold_repr IS NOT NULL AND p.decoded IS NOT NULL THEN (p.canon IS NOT NULL)::INT::DOUBLE END AS entity_validity
    FROM evals e JOIN frag USING (id) LEFT JOIN decoded p ON p.code = e.pred LEFT JOIN decoded g ON g.code = e.gold_repr""",
)
def m6(spark, sf):
    d = evals(spark, sf).withColumnRenamed("gold_repr", "ref")
    names = ("em", "bleu1", "validity", "lev", "lev_norm", *ENTITY)
    return _rounded(M.string_to_code_frame(d, decoded_table(spark, sf)), names)


@query("M7_first_generation", f"WITH {SQL_FRAG}, {SQL_ENTITY} SELECT id, text_em AS fragment_em, {', '.join((FRAG + ENTITY)[1:])} FROM frag JOIN entity USING (id)")
def m7(spark, sf):
    return _rounded(M.generated_fragment_frame(evals(spark, sf), decoded_table(spark, sf), multiset=False), FRAG + ENTITY)


def summary(spark, sf):
    e, d = evals(spark, sf), decoded_table(spark, sf)
    frames = {
        "identify": e.withColumns(M.fragment_metrics(F.col("gold"), F.col("pred"))),
        "generate": M.generated_fragment_frame(e, d),
        "rewrite": M.generated_string_frame(e, d),
    }
    return M.evaluation_summary(M.long_metrics(frames, ["step", "model"]), ["task", "step", "model"])


SQL_SUMMARY = f"""{SQL_FRAG}, {SQL_ENTITY}, {SQL_STRING}, lm AS (
  {' UNION ALL '.join(f"SELECT 'identify' AS task, id, '{c}' AS metric, {c} AS value FROM frag" for c in FRAG)} UNION ALL
  {' UNION ALL '.join(f"SELECT 'generate', id, '{c}', {c} FROM frag" for c in FRAG)} UNION ALL {' UNION ALL '.join(f"SELECT 'generate', id, '{c}', {c} FROM entity" for c in ENTITY)} UNION ALL
  {' UNION ALL '.join(f"SELECT 'rewrite', id, '{c}', {c} FROM strings" for c in STRING)}),
summary AS (SELECT task, step, model, metric, count(*) AS total, sum(value) / count(*) AS mean FROM lm JOIN evals USING (id) GROUP BY ALL)"""


@query("M8_evaluation_summary", f"WITH {SQL_SUMMARY} SELECT task, step, model, metric, total, round(mean, 4) AS mean FROM summary")
def m8(spark, sf):
    return summary(spark, sf).withColumn("mean", F.round("mean", 4))


_MAIN = {"identify": "fragment_em", "generate": "fragment_em", "first": "text_em", "rewrite": "exact_match", "rewrite_code": "exact_match", "code": "text_em"}


@query(
    "M8_task_accuracy",
    f"""WITH {SQL_FRAG}, {SQL_STRING}, hits AS ({' UNION ALL '.join(f"SELECT '{t}' AS task, id, {m} = 1 AS hit FROM {'strings' if m == 'exact_match' else 'frag'}" for t, m in _MAIN.items())})
    SELECT task, model, count(*) AS total, sum(coalesce(hit, false)::INT)::BIGINT AS correct, sum(coalesce(hit, false)::INT) / count(*) AS accuracy FROM hits JOIN evals USING (id) GROUP BY ALL""",
)
def m8_accuracy(spark, sf):
    e = evals(spark, sf)
    tasks = {t: e.withColumnRenamed("gold_repr", "ref") if t == "code" else e for t in _MAIN}
    return M.evaluate(tasks, decoded_table(spark, sf), ["model"])


SQL_REASON = f"""{SQL_EVALS}, reasons AS (SELECT e.id, e.model, CASE WHEN e.pred = '' THEN 'empty' WHEN p.decoded IS NULL THEN 'decode_failed:' || coalesce(p.error, 'unknown')
  WHEN p.canon IS NULL THEN 'invalid:' || coalesce(p.error, 'unknown') END AS reason FROM evals e LEFT JOIN decoded p ON p.code = e.pred)"""


@query("M9_validity_reasons", f"WITH {SQL_REASON} SELECT model, reason, count(*) AS n FROM reasons WHERE reason IS NOT NULL GROUP BY ALL")
def m9(spark, sf):
    return reason_histogram(M.validity_reason(evals(spark, sf), decoded_table(spark, sf)), ["model"])


@query(
    "M10_report",
    f"""WITH {SQL_SUMMARY}, g AS (SELECT * FROM (SELECT DISTINCT task FROM summary), (SELECT DISTINCT step FROM evals), (SELECT unnest(['m0', 'm1', 'm2', 'm9']) AS model))
    SELECT g.task, g.step, g.model, {', '.join(f"round(max(CASE WHEN metric = '{c}' THEN mean END), 4) AS {c}" for c in ('fragment_em', 'fragment_f1', 'exact_match', 'validity'))}
    FROM g LEFT JOIN summary s ON s.task = g.task AND s.step = g.step AND s.model = g.model GROUP BY ALL""",
)
def m10(spark, sf):
    s = summary(spark, sf)
    models = F.explode(F.array(*[F.lit(m) for m in ("m0", "m1", "m2", "m9")])).alias("model")
    tasks = F.explode(F.array(*[F.lit(t) for t in ("identify", "generate", "rewrite")])).alias("task")
    steps = evals(spark, sf).select("step").distinct()
    grid = steps.select("step", tasks).select("*", models)
    shown = ("fragment_em", "fragment_f1", "exact_match", "validity")
    r = M.report_table(s, grid, ["task", "step", "model"], shown)
    return r.select("task", "step", "model", *[F.round(c, 4).alias(c) for c in shown])


# --- best cases: pairs of parts, with the answers of their order lines --------------------------------

SQL_CASES = f"""{SQL_CASE_PAIRS}, answers AS (SELECT l_orderkey, l_linenumber, l_partkey - l_partkey % 2 AS source_index, l_linestatus AS task,
    CASE WHEN l_quantity < 25 THEN 'single_step' ELSE 'multi_step' END AS step, 'm' || l_linenumber AS model, l_returnflag AS gold, substr(p_name, 1, 1) AS pred
  FROM lineitem JOIN part ON p_partkey = l_partkey),
sc AS (SELECT a.*, c.*, 0.55 * sim + 0.30 * n_common / greatest(len(x), len(y)) + 0.15 * n_common / (len(x) + len(y)) - 0.12 * abs(len(x) - len(y)) / greatest(len(x), len(y))
    - 0.06 * abs(l_size - r_size) / greatest(l_size, r_size) - 0.03 * abs(n_left - n_right) AS score
  FROM answers a JOIN case_pairs c USING (source_index)
  WHERE upper(trim(gold)) = upper(trim(pred)) AND sim >= 0.62 AND (step <> 'single_step' OR (n_left = 1 AND n_right = 1))),
best AS (SELECT *, row_number() OVER (PARTITION BY task, step, model ORDER BY score DESC, source_index, l_orderkey, l_linenumber) AS rank FROM sc)"""


def case_answers(spark, sf):
    """Each order line answers for its part's pair: gold is its flag, the prediction the part's initial."""
    part = table(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), F.substring("p_name", 1, 1).alias("pred"))
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_linestatus", "l_returnflag")
    return li.join(part, "l_partkey").select(
        "l_orderkey",
        "l_linenumber",
        (F.col("l_partkey") - F.col("l_partkey") % 2).alias("source_index"),
        F.col("l_linestatus").alias("task"),
        F.when(F.col("l_quantity") < 25, "single_step").otherwise("multi_step").alias("step"),
        F.concat(F.lit("m"), F.col("l_linenumber").cast("string")).alias("model"),
        F.col("l_returnflag").alias("gold"),
        "pred",
    )


def cases(spark, sf):
    c = case_pairs(spark, sf)
    longest = F.greatest("n_x", "n_y")
    features = c.select(
        "source_index",
        "sim",
        (F.col("n_common") / longest).alias("shared_atoms"),
        (F.col("n_common") / (F.col("n_x") + F.col("n_y"))).alias("shared_bonds"),
        (F.abs(F.col("n_x") - F.col("n_y")) / longest).alias("atom_gap"),
        (F.abs(F.col("l_size") - F.col("r_size")) / F.greatest("l_size", "r_size")).alias("bond_gap"),
        F.abs(F.col("n_left") - F.col("n_right")).alias("ring_gap"),
        "only_left",
        "only_right",
        "n_left",
        "n_right",
        "n_common",
    )
    return M.best_cases(case_answers(spark, sf), features, 2, show=["n_left", "n_right", "n_common"], ties=["l_orderkey", "l_linenumber"])


@query(
    "M11_best_cases",
    f"""WITH {SQL_CASES} SELECT task, step, model, source_index, l_orderkey, CAST(rank AS INTEGER) AS rank, round(score, 6)::DOUBLE AS score FROM best WHERE rank <= 2""",
)
def m11(spark, sf):
    return cases(spark, sf).select("task", "step", "model", "source_index", "l_orderkey", "rank", F.round("score", 6).alias("score"))


@query(
    "M12_augmented_cases",
    f"""WITH {SQL_CASES} SELECT task, step, model, source_index, CAST(n_left AS INTEGER) AS counts_left, CAST(n_right AS INTEGER) AS counts_right,
      CAST(length(only_left) AS INTEGER) AS counts_left_size, round(sim, 6) AS features_sim, CAST(n_common AS INTEGER) AS features_common FROM best WHERE rank <= 2""",
)
def m12(spark, sf):
    """Nested case records flattened to a wide table."""
    d = cases(spark, sf).select(
        "task",
        "step",
        "model",
        "source_index",
        F.struct(F.col("n_left").alias("left"), F.col("n_right").alias("right"), F.length("only_left").alias("left_size")).alias("counts"),
        F.struct(F.round("sim", 6).alias("sim"), F.col("n_common").alias("common")).alias("features"),
    )
    return M.flatten(d, {"counts": ["left", "right", "left_size"], "features": ["sim", "common"]})


# --- the encode-once job ----------------------------------------------------------------------


@query(
    "E1_encode_once",
    f"""WITH v AS (SELECT DISTINCT text FROM documents) SELECT md5(text) AS code, CASE WHEN trim(text) = '' THEN 'empty' ELSE 'ok' END AS status, CAST(len({SQL_WORDS.format('text')}) AS INTEGER) AS n_bits,
      CAST(len(string_split(string_split(text, chr(10))[1], ' ')) AS VARCHAR) AS formula, string_split(text, ' ')[1] AS group_key, CAST(len({SQL_FRAGMENTS.format('text')}) AS INTEGER) AS n_frags, CAST(length(text) AS INTEGER) AS n_chars FROM v""",
)
def e1(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "text")
    store = E.text_features(E.distinct_values(d.filter("doc_id % 3 = 0"), ["text"]))
    f = E.encode_once(d, ["text"], E.text_features, store)
    return f.select(
        F.md5("value").alias("code"), "status", F.size("bits").alias("n_bits"), "formula", "group_key", F.size("frags").alias("n_frags"), "n_chars"
    )


def _line_stats(batch):
    """User encoder used in the query below; it rejects texts with a tab."""
    if batch.str.contains("\t", regex=False).any():
        raise ValueError("tab in text")
    return pd.DataFrame({"n_lines": batch.str.count("\n") + 1, "n_code_points": batch.str.len()})


@query(
    "E1_encode_user_function",
    """SELECT DISTINCT md5(text) AS code, CASE WHEN contains(text, chr(9)) THEN 'error' ELSE 'ok' END AS status, CASE WHEN contains(text, chr(9)) THEN 'tab in text' END AS error,
      CASE WHEN NOT contains(text, chr(9)) THEN len(string_split(text, chr(10))) END AS n_lines, CASE WHEN NOT contains(text, chr(9)) THEN length(text) END AS n_code_points FROM documents""",
)
def e1_user(spark, sf):
    E.register_encoder("line_stats", _line_stats, "n_lines long, n_code_points long")
    values = E.distinct_values(table(spark, sf, "documents"), ["text"])
    return E.encode(values, "line_stats").withColumn("code", F.md5("value")).drop("value")


@query("E2_pairwise_function", f"WITH {SQL_TURNS} SELECT source_index, abs(length(left_repr) - length(right_repr)) AS gap FROM turns")
def e2(spark, sf):
    def gap(a: pd.Series, b: pd.Series) -> pd.Series:
        return (a.str.len() - b.str.len()).abs()

    return E.apply_to_pairs(turns(spark, sf), "gap", gap, "left_repr", "right_repr", "long").select("source_index", "gap")
