"""Question/answer tables on the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from pairloom.operators import qa as Q
from pairloom.operators.choices import letter
from pairloom.plans.frames import SQL_PREDICTIONS, predictions
from pairloom.plans.q_filters import SQL_CODES, compared
from pairloom.plans.q_ranking import SQL_CHOICES, SQL_SHOTS, choice_frame, example_text, shots
from pairloom.plans.q_rowdiff import SQL_DIFF, SQL_PLAN_TEXT, SQL_SITES, sql_unique, typed_pairs
from pairloom.plans.registry import query, table

SEED = 42

# the dataset 'set0' has a text of its own and one for its endpoint 'ep0'; 'set1' has only the first
_DESCRIPTIONS = [("set0", None, "Dataset zero."), ("set0", "ep0", "Endpoint zero of dataset zero."), ("set1", None, "Dataset one.")]
SQL_CONTEXT = "CASE WHEN dataset_name = 'set0' AND endpoint = 'ep0' THEN 'Endpoint zero of dataset zero.' WHEN dataset_name = 'set0' THEN 'Dataset zero.' WHEN dataset_name = 'set1' THEN 'Dataset one.' ELSE 'No description.' END"


def descriptions(spark):
    return spark.createDataFrame(_DESCRIPTIONS, "dataset_name string, endpoint string, text string")


def qa_input(spark, sf):
    d = compared(spark, sf).select(
        "source_index",
        "dataset_name",
        "endpoint",
        "left_repr",
        "right_repr",
        "left_code",
        "right_code",
        "only_left",
        "only_right",
    )
    d = Q.with_context(d, descriptions(spark), "No description.").withColumn("repre", F.lit("both_repre"))
    return d.withColumn("shown", Q.representation("left_repr", "left_code", F.col("repre")))


_SHOWN = "'TEXT = ''' || trim(left_repr) || ''', CODE = ''' || left_code || ''''"
SQL_QA = f"""{SQL_CODES}, q AS (SELECT t.source_index, t.dataset_name, t.endpoint, left_repr, right_repr, left_code, right_code, only_left, only_right, {SQL_CONTEXT} AS context, {_SHOWN} AS shown,
    n_only_left, n_only_right, chr(10) AS nl FROM codes t JOIN (SELECT source_index, only_left, only_right, n_only_left, n_only_right FROM cmp) USING (source_index)),
s AS (SELECT *, CASE WHEN n_only_left >= 2 THEN 'multi_step' ELSE 'single_step' END AS step1, CASE WHEN greatest(n_only_left, n_only_right) >= 2 THEN 'multi_step' ELSE 'single_step' END AS step2 FROM q),
rec AS (
  SELECT 'identify' AS task, step1 AS step, source_index, context || nl || 'Which parts of the active entity ' || shown || ' cause its label?' AS question, to_json({{'answer': only_left}})::VARCHAR AS answer FROM s
  UNION ALL SELECT 'generate', step2, source_index, context || nl || 'Active entity: ' || shown || nl || 'Parts to replace: ' || only_left || nl || 'Give the replacing parts.', to_json({{'answer': only_right}})::VARCHAR FROM s
  UNION ALL SELECT 'rewrite', step2, source_index, context || nl || 'Active entity: ' || shown || nl || 'Write the inactive counterpart.', to_json({{'answer': right_repr}})::VARCHAR FROM s
  UNION ALL SELECT 'rewrite_code', step2, source_index, context || nl || 'Active entity: ' || shown || nl || 'Write the code of the inactive counterpart.', to_json({{'answer': right_code}})::VARCHAR FROM s
  UNION ALL SELECT 'instructed', step2, source_index, context || nl || 'Active entity: ' || shown || nl || CASE WHEN step2 = 'single_step' THEN 'Swap ''' ELSE 'Swap, one after the other, ''' END || only_left || ''' for ''' || only_right || '''.', to_json({{'answer': right_repr}})::VARCHAR FROM s
  UNION ALL SELECT 'stepwise', step2, source_index, context || nl || 'Active entity: ' || shown || nl || 'Name the parts to replace, the replacing parts, and the counterpart.', to_json({{'answer': right_repr, 'step1': only_left, 'step2': only_right}})::VARCHAR FROM s
  UNION ALL SELECT 'stepwise_code', step2, source_index, context || nl || 'Active entity: ' || shown || nl || 'Name the parts to replace, the replacing parts, and the counterpart''s code.', to_json({{'answer': right_code, 'step1': only_left, 'step2': only_right}})::VARCHAR FROM s),
qa AS (SELECT *, row_number() OVER (PARTITION BY task, step ORDER BY md5('42' || source_index), source_index::VARCHAR) - 1 AS id FROM rec)"""


@query("Q1_task_tables", f"WITH {SQL_QA} SELECT task, step, id, source_index, question, answer FROM qa")
def q1(spark, sf):
    return Q.task_tables(qa_input(spark, sf), SEED).select("task", "step", "id", "source_index", "question", "answer")


@query(
    "Q2_code_tables",
    """WITH d AS (SELECT p_partkey AS key, p_name AS text, CASE WHEN p_size % 5 = 0 THEN ' ' ELSE p_brand || '.' || p_type END AS code FROM part WHERE p_partkey % 3 <> 0)
    SELECT 'code_to_text' AS task, key, 'Decode: ' || code AS question, text AS answer FROM d WHERE trim(code) <> ''
    UNION ALL SELECT 'text_to_code', key, 'Encode: ' || text, code FROM d WHERE trim(code) <> ''""",
)
def q2(spark, sf):
    d = table(spark, sf, "part").select(
        F.col("p_partkey").alias("key"),
        F.col("p_name").alias("text"),
        F.when(F.col("p_size") % 5 == 0, " ").otherwise(F.concat("p_brand", F.lit("."), "p_type")).alias("code"),
        F.when(F.col("p_partkey") % 3 == 0, "test").otherwise("train").alias("split"),
    )
    return Q.code_tables(d, "train")


@query(
    "Q3_representation_variants",
    f"""WITH {SQL_CODES} SELECT source_index, v AS repre, CASE v WHEN 'only_text' THEN 'TEXT = ''' || trim(left_repr) || '''' WHEN 'only_code' THEN CASE WHEN left_code = '' THEN '' ELSE 'CODE = ''' || left_code || '''' END ELSE {_SHOWN} END AS shown
    FROM codes, (SELECT unnest(['only_text', 'only_code', 'both_repre']) AS v)""",
)
def q3(spark, sf):
    d = Q.with_variants(compared(spark, sf).select("source_index", "left_repr", "left_code"))
    return d.select("source_index", "repre", Q.representation("left_repr", "left_code", F.col("repre")).alias("shown"))


@query("Q4_endpoint_context", f"WITH {SQL_PREDICTIONS} SELECT id, {SQL_CONTEXT} AS context FROM predictions")
def q4(spark, sf):
    return Q.with_context(predictions(spark, sf), descriptions(spark), "No description.").select("id", "context")


@query(
    "Q5_instruction_text",
    f"""WITH {SQL_QA} SELECT source_index, CASE WHEN step2 = 'single_step' THEN 'Swap ''' ELSE 'Swap, one after the other, ''' END || only_left || ''' for ''' || only_right || '''.' AS instruction FROM s""",
)
def q5(spark, sf):
    d = qa_input(spark, sf)
    step = Q.step_of_fragments(F.col("only_left"), F.col("only_right"))
    return d.select("source_index", Q.instruction(F.col("only_left"), F.col("only_right"), step).alias("instruction"))


@query(
    "Q6_shot_variants",
    f"""WITH {SQL_SHOTS} SELECT q_id, CAST(k AS INTEGER) AS shots, string_agg(p_id || ':' || w, ',' ORDER BY n) AS examples FROM s2, (SELECT unnest([1, 2, 4]) AS k) WHERE n <= k GROUP BY q_id, k""",
)
def q6(spark, sf):
    d = Q.shot_variants(shots(spark, sf, 4), "examples")
    return d.select("q_id", "shots", example_text("examples").alias("examples"))


@query(
    "Q7_choice_tables",
    f"""WITH {SQL_CHOICES} SELECT id, array_to_string(list_transform(vs, lambda x, i: chr(64 + i::INT) || '. ' || x), chr(10)) AS options, chr(65 + answer_index) AS letter, answer_index FROM mcq""",
)
def q7(spark, sf):
    return Q.choice_table(choice_frame(spark, sf))


def typed(spark, sf):
    return typed_pairs(spark, sf).withColumnsRenamed({"left_p_name": "left_repr", "right_p_name": "right_repr"})


SQL_TYPED = f"""{SQL_DIFF}, nm AS (SELECT *, list_sort(list_filter(l_all, lambda x: NOT list_contains(r_all, x))) AS own_left, list_sort(list_filter(r_all, lambda x: NOT list_contains(l_all, x))) AS right_names,
  CASE WHEN same_names THEN moved ELSE [] END AS mv FROM typed),
tk AS (SELECT *, CASE WHEN len(own_left) > 0 THEN own_left WHEN len(mv) > 0 THEN mv ELSE right_names END AS left_names FROM nm),
fgk AS (SELECT * FROM tk WHERE diff_type = 'only_fg' AND len(left_names) > 0),
stk AS (SELECT * FROM tk WHERE diff_type = 'only_stereo' AND len(l_c) + len(r_c) + len(l_b) + len(r_b) > 0)"""


@query(
    "Q8_task_registry",
    f"""WITH {SQL_TYPED}, r AS (SELECT * FROM (SELECT unnest(['identify', 'localise', 'plan', 'repair', 'remove_add']) AS kind)),
    a AS (SELECT 'only_fg' AS style, kind, step_num, pair_id FROM fgk, r UNION ALL SELECT 'only_stereo', kind, step_num, pair_id FROM stk, r)
    SELECT style, kind, step_num, count(*) AS n, count(DISTINCT pair_id) AS n_pairs FROM a GROUP BY ALL""",
)
def q8(spark, sf):
    d = Q.difference_tasks(typed(spark, sf))
    return d.groupBy("style", "kind", "step_num").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("pair_id").alias("n_pairs"))


def _task(style, kind):
    def run(spark, sf):
        return Q.difference_task(typed(spark, sf), style, kind).select("qa_id", "step_num", "question", "answer")

    return run


def _task_sql(style, kind, question, answer):
    source = "fgk" if style == "only_fg" else "stk"
    return f"WITH {SQL_TYPED} SELECT '{style}_{kind}_' || step_num || '_' || pair_id AS qa_id, step_num, {question} AS question, {answer} AS answer FROM {source}"


_J = "'[' || array_to_string(list_transform({0}, lambda x: '\"' || x || '\"'), ',') || ']'"
_POS = "list_filter(range(len({side}_words)), lambda i: {side}_words[i + 1] = n)"
_SITES = "'[' || array_to_string(flatten(list_transform(left_names, lambda n: list_transform(list_filter(range(len(l_words)), lambda i: l_words[i + 1] = n), lambda i: '{\"name\":\"' || n || '\",\"indices\":[' || i || ']}'))), ',') || ']'"
# both sides need something to name when a pair is edited
_ADDED_NAMES = "CASE WHEN len(right_names) > 0 THEN right_names WHEN len(mv) > 0 THEN mv ELSE left_names END"


def _placed(side, names):
    places = f"'[' || array_to_string(list_transform({_POS.format(side=side)}, lambda i: '[' || i || ']'), ',') || ']'"
    return f"'[' || array_to_string(list_transform({names}, lambda n: '{{\"name\":\"' || n || '\",\"places\":' || {places} || '}}'), ',') || ']'"


def _listed(side, names):
    return f"array_to_string(list_transform({names}, lambda n: n || ' at ' || array_to_string({_POS.format(side=side)}, ', ')), '; ')"


_EDITS = "array_to_string(list_concat(list_transform(left_names, lambda n: '-' || n), list_transform(right_names, lambda n: '+' || n)), ' ')"
_FG_HEAD = "'Pair: ' || l_name || ' | ' || r_name || chr(10) || 'Names: ' || array_to_string(list_sort(list_distinct(list_concat(l_all, r_all))), ', ')"
_FG_ANSWERS = {
    "identify": "'{\"answer\":' || " + _J.format("left_names") + " || '}'",
    "localise": "'{\"sites\":' || " + _SITES + " || '}'",
    "plan": f"'{{\"out\":' || {_placed('l', 'left_names')} || ',\"in\":' || {_placed('r', 'right_names')} || ',\"edits\":\"' || {_EDITS} || '\"}}'",
    "repair": f"'{{\"target\":\"' || r_name || '\",\"edits\":\"' || {_EDITS} || '\"}}'",
    "remove_add": "'{\"target\":\"' || r_name || '\"}'",
}
for _letter, _kind in zip("abcde", Q.KINDS):
    _question = _FG_HEAD
    if _kind == "remove_add":
        _question += f" || chr(10) || 'Out: ' || {_listed('l', 'left_names')} || chr(10) || 'In: ' || {_listed('r', _ADDED_NAMES)}"
    query(f"Q8{_letter}_fg_{_kind}", _task_sql("only_fg", _kind, _question, _FG_ANSWERS[_kind]))(_task("only_fg", _kind))

_REC_C = "'{\"kind\":\"centre\",\"key\":[' || x.atom_idx || '],\"value\":\"' || x.config || '\"}'"
_REC_B = "'{\"kind\":\"bond\",\"key\":[' || array_to_string(x.bond, ',') || '],\"value\":\"' || x.geometry || '\"}'"
_REMOVED = f"list_concat(list_transform(lc_only, lambda x: {_REC_C}), list_transform(lb_only, lambda x: {_REC_B}))"
# the other side's value of the same key, in the left side's order
_ADDED = (
    f"list_concat(flatten(list_transform(lc_only, lambda y: list_transform(list_filter(r_c, lambda x: x.atom_idx = y.atom_idx), lambda x: {_REC_C}))), "
    f"flatten(list_transform(lb_only, lambda y: list_transform(list_filter(r_b, lambda x: x.bond = y.bond), lambda x: {_REC_B}))))"
)
_STEREO_HEAD = "'Pair: ' || l_name || ' | ' || r_name"
_STEREO_ANSWERS = {
    "identify": "'{\"answer\":' || " + _J.format(f"CASE WHEN len({sql_unique('l')}) > 0 THEN {sql_unique('l')} ELSE {sql_unique('r')} END") + " || '}'",
    "localise": "'{\"sites\":' || " + SQL_SITES + " || '}'",
    "plan": f"'{{\"removed\":[' || array_to_string({_REMOVED}, ',') || '],\"added\":[' || array_to_string({_ADDED}, ',') || '],\"strategy\":\"centres ' || len(lc_only) || ', bonds ' || len(lb_only) || '\"}}'",
    "repair": "'{\"target\":\"' || r_name || '\"}'",
    "remove_add": "'{\"target\":\"' || r_name || '\"}'",
}
_WISHES = {"repair": "Differences:", "remove_add": "Edits to make:"}
for _letter, _kind in zip("fghij", Q.KINDS):
    _question = _STEREO_HEAD
    if _kind in _WISHES:
        _question += f" || chr(10) || '{_WISHES[_kind]}' || chr(10) || {SQL_PLAN_TEXT}"
    query(f"Q8{_letter}_stereo_{_kind}", _task_sql("only_stereo", _kind, _question, _STEREO_ANSWERS[_kind]))(_task("only_stereo", _kind))


@query(
    "Q9_aligned_tables",
    f"""WITH {SQL_QA}, a AS (SELECT source_index FROM s WHERE n_only_left > 0 INTERSECT SELECT source_index FROM s WHERE n_only_right > 0),
    i AS (SELECT source_index, row_number() OVER (ORDER BY md5('42' || source_index), source_index::VARCHAR) - 1 AS id FROM a)
    SELECT 'identify' AS task, id, source_index, only_left AS answer FROM s JOIN i USING (source_index) UNION ALL SELECT 'generate', id, source_index, only_right FROM s JOIN i USING (source_index)
    UNION ALL SELECT 'context', id, source_index, NULL FROM s JOIN i USING (source_index)""",
)
def q9(spark, sf):
    d = qa_input(spark, sf)
    tables = {
        "identify": d.filter("only_left <> ''").select("source_index", F.col("only_left").alias("answer")),
        "generate": d.filter("only_right <> ''").select("source_index", F.col("only_right").alias("answer")),
        "context": d.select("source_index"),  # what later stages may see: no answers
    }
    return Q.aligned_tables(tables, SEED).select("task", "id", "source_index", "answer")


SQL_AUDIT = f"{SQL_PREDICTIONS}, p AS (SELECT task, string_split(pred, ' ')[1] AS question, gold, CASE WHEN conv_id % 5 = 0 THEN 'test' ELSE 'train' END AS split FROM predictions)"


def audit_frame(spark, sf):
    return predictions(spark, sf).select(
        "task", F.split("pred", " ")[0].alias("question"), "gold", F.when(F.col("conv_id") % 5 == 0, "test").otherwise("train").alias("split")
    )


@query(
    "Q10_split_overlap",
    f"""WITH {SQL_AUDIT}, k AS (SELECT task, question, max((split = 'train')::INT) AS tr, max((split = 'test')::INT) AS te FROM p GROUP BY ALL)
    SELECT task, sum(tr)::BIGINT AS n_train, sum(te)::BIGINT AS n_test, sum(tr * te)::BIGINT AS n_both FROM k GROUP BY task""",
)
def q10(spark, sf):
    return Q.split_overlap(audit_frame(spark, sf), "question")


@query("Q10_multi_answer", f"WITH {SQL_AUDIT} SELECT question, count(*) AS n_rows, count(DISTINCT gold) AS n_answers FROM p GROUP BY question HAVING count(DISTINCT gold) > 1")
def q10_multi(spark, sf):
    return Q.multi_answer_questions(audit_frame(spark, sf), "question", "gold")
