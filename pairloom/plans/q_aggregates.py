"""Aggregations on the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from pairloom.functions.sets import fragments, tanimoto, words
from pairloom.operators import aggregates as A
from pairloom.operators import contrast as C
from pairloom.operators import knn
from pairloom.operators import simjoin as S
from pairloom.operators.filters import pair_step, pair_type
from pairloom.operators.setops import conflicted_entities
from pairloom.plans.frames import (
    SQL_FRAGMENTS,
    SQL_LABELLED,
    SQL_PREDICTIONS,
    SQL_TRADES,
    SQL_TURNS,
    SQL_WORDS,
    parity_docs,
    TRADE_PROPS,
    labelled,
    predictions,
    trades,
    turns,
)
from pairloom.plans.part_pairs import SQL_PART_PAIRS, part_entities
from pairloom.plans.q_filters import SQL_KINDS, kinds
from pairloom.plans.q_joins import (
    SQL_ALIGNED,
    SQL_CONTRASTIVE,
    SQL_SETS,
    aligned_three,
    page_entities,
    parity_sets,
)
from pairloom.plans.registry import query, table
from pairloom.session import cut, together


def rounded(df, *columns, digits=6):
    return df.withColumns({c: F.round(c, digits) for c in columns})


SQL_SIZES = "np AS (SELECT lang, sum(CASE WHEN label = 1 THEN n_members END)::BIGINT AS n_pos, sum(CASE WHEN label = 0 THEN n_members END)::BIGINT AS n_neg FROM sets GROUP BY lang)"


@query(
    "A1_similarity_summary",
    f"""WITH {SQL_SETS}, {SQL_SIZES}, s AS (SELECT lang, sum(i / u * n_pairs) AS s1, max(i / u) AS mx, min(i / u) AS mn, sum(n_pairs) AS seen FROM sims GROUP BY lang)
    SELECT lang, n_pos, n_neg, n_pos * n_neg AS n_pairs, round(coalesce(s1, 0) / (n_pos * n_neg), 8) AS mean_sim, round(coalesce(mx, 0), 6) AS max_sim,
      CASE WHEN coalesce(seen, 0) < n_pos * n_neg THEN 0.0::DOUBLE ELSE round(mn, 6) END AS min_sim FROM np LEFT JOIN s USING (lang) WHERE n_pos * n_neg > 0""",
)
def a1(spark, sf):
    left, right = parity_sets(spark, sf)
    d = knn.similarity_stats(left, right, ["lang"])
    return rounded(d, "max_sim", "min_sim").select(
        "lang", "n_pos", "n_neg", "n_pairs", F.round("mean_sim", 8).alias("mean_sim"), "max_sim", "min_sim"
    )


@query(
    "A2_similarity_distribution",
    f"""WITH {SQL_SETS}, {SQL_SIZES}, lr AS (SELECT a.lang, a.first_id AS l_id, b.first_id AS r_id, a.n_members * b.n_members AS w
       FROM sets a JOIN sets b ON a.lang = b.lang AND a.label = 1 AND b.label = 0),
    v AS (SELECT lr.lang, lr.l_id, lr.r_id, lr.w, coalesce(i / u, 0) AS sim, coalesce(i, 0) AS i, coalesce(u, 1) AS u FROM lr LEFT JOIN sims USING (lang, l_id, r_id)),
    x AS (SELECT lang, sim FROM v, range(w)),
    m AS (SELECT lang, median(sim) AS med, stddev_pop(sim) AS sd, count(*) AS n FROM x GROUP BY lang),
    g AS (SELECT lang, max(sim) AS mx, sum(CASE WHEN i * 10 > u * 5 THEN w ELSE 0 END)::BIGINT AS n_gt_50, sum(CASE WHEN i * 10 > u * 6 THEN w ELSE 0 END)::BIGINT AS n_gt_60,
      sum(CASE WHEN i * 10 > u * 7 THEN w ELSE 0 END)::BIGINT AS n_gt_70, sum(CASE WHEN i * 10 > u * 8 THEN w ELSE 0 END)::BIGINT AS n_gt_80, sum(CASE WHEN i * 10 > u * 9 THEN w ELSE 0 END)::BIGINT AS n_gt_90 FROM v GROUP BY lang),
    best AS (SELECT lang, l_id, r_id, row_number() OVER (PARTITION BY lang ORDER BY sim DESC, l_id, r_id) AS rn FROM v WHERE i > 0)
    SELECT m.lang, n AS n_pairs, round(med, 6) AS median_sim, round(sd, 6) AS std_sim, round(mx, 6) AS max_sim, best.l_id AS best_left, best.r_id AS best_right,
      n_gt_50, n_gt_60, n_gt_70, n_gt_80, n_gt_90 FROM m JOIN g USING (lang) LEFT JOIN best ON best.lang = m.lang AND rn = 1""",
)
def a2(spark, sf):
    left, right = parity_sets(spark, sf)
    d = knn.similarity_stats(left, right, ["lang"])
    return rounded(d, "median_sim", "std_sim", "max_sim").drop("n_pos", "n_neg", "mean_sim", "min_sim")


@query(
    "A3_pair_counts",
    f"""WITH {SQL_SETS}, {SQL_SIZES}, p AS (SELECT lang, sum(n_pairs) AS n FROM sims WHERE i * 2 >= u GROUP BY lang)
    SELECT lang, n_pos, n_neg, coalesce(n, 0)::BIGINT AS n_pairs FROM np LEFT JOIN p USING (lang) WHERE n_pos IS NOT NULL AND n_neg IS NOT NULL""",
)
def a3(spark, sf):
    left, right = parity_sets(spark, sf)
    return A.pair_counts(S.similar_sets(left, right, ["lang"], 1, 2), left, right, ["lang"])


@query(
    "A4_condition_counts",
    f"""WITH {SQL_CONTRASTIVE} SELECT CASE WHEN GROUPING(dataset_name) = 1 THEN 'total' ELSE dataset_name END AS dataset_name,
      CASE WHEN GROUPING(endpoint) = 1 THEN 'total' ELSE endpoint END AS endpoint, count(*) FILTER (sub_ok) AS sub, count(*) FILTER (chiral_ok) AS chiral,
      count(*) FILTER (group_ok) AS grp, count(*) FILTER (string_ok) AS string, count(*) FILTER (is_fg) AS any_fg
    FROM contrastive GROUP BY GROUPING SETS ((dataset_name, endpoint), ())""",
)
def a4(spark, sf):
    pairs = C.with_styles(C.ContrastivePairs(page_entities(spark, sf)).weighted())
    flags = {"sub": "sub_ok", "chiral": "chiral_ok", "grp": "group_ok", "string": "string_ok", "any_fg": "is_fg"}
    return A.condition_counts(
        pairs, ["dataset_name", "endpoint"], {n: F.col(c) for n, c in flags.items()}, F.col("n_pairs")
    )


@query(
    "A5_equal_group_counts",
    f"""WITH {SQL_CONTRASTIVE} SELECT CASE WHEN GROUPING(dataset_name) = 1 THEN 'total' ELSE dataset_name END AS dataset_name,
      count(*) FILTER (group_same) AS group_eq, count(*) FILTER (sub_ok OR group_same OR string_ok) AS fg,
      count(*) FILTER (chiral_ok OR group_same OR string_ok) AS stereo, count(*) FILTER ((chiral_ok OR group_same OR string_ok) AND same_formula) AS isomer
    FROM contrastive GROUP BY GROUPING SETS ((dataset_name), ())""",
)
def a5(spark, sf):
    """Group similarity of at least 1 - 1e-6 is equality of the group sets."""
    chiral = F.col("chiral_ok") | F.col("group_same") | F.col("string_ok")
    return A.condition_counts(
        C.ContrastivePairs(page_entities(spark, sf)).weighted(),
        ["dataset_name"],
        {
            "fg": F.col("sub_ok") | F.col("group_same") | F.col("string_ok"),
            "stereo": chiral,
            "isomer": chiral & F.col("same_formula"),
            "group_eq": F.col("group_same"),
        },
        F.col("n_pairs"),
    )


_STEPS = range(10, 19)


SQL_CASED = "list_distinct(list_filter(regexp_split_to_array(text, '[^\\p{L}\\p{N}]+'), lambda x: x <> ''))"
SQL_TWO_MEASURES = f"""both_bits AS (SELECT lang, doc_id, CAST(doc_id % 2 AS INTEGER) AS label, 'plain' AS measure, {SQL_WORDS.format('text')} AS bits FROM documents
  UNION ALL SELECT lang, doc_id, CAST(doc_id % 2 AS INTEGER), 'cased', {SQL_CASED} FROM documents),
t AS (SELECT lang, measure, label, doc_id, len(bits) AS n, unnest(bits) AS tok FROM both_bits),
o AS (SELECT a.lang, a.measure, any_value(a.n) + any_value(b.n) - count(*) AS u, count(*) AS i FROM t a JOIN t b ON a.lang = b.lang AND a.measure = b.measure AND a.tok = b.tok
  WHERE a.label = 1 AND b.label = 0 GROUP BY a.lang, a.measure, a.doc_id, b.doc_id)"""


@query(
    "A6_threshold_table",
    f"""WITH {SQL_TWO_MEASURES} SELECT CASE WHEN GROUPING(lang) = 1 THEN 'total' ELSE lang END AS lang, {', '.join(
        f"count(*) FILTER (measure = '{m}' AND i * 20 >= u * {t}) AS {m}_{t * 5:03d}" for m in ("plain", "cased") for t in _STEPS)}
    FROM o WHERE i * 2 >= u GROUP BY ROLLUP (lang)""",
)
def a6(spark, sf):
    """Two measures in one pass: the sets of both are blocks of one table with one token order and one candidate table."""
    d = parity_docs(spark, sf)
    cased = F.array_distinct(F.filter(F.split("text", r"[^\p{L}\p{N}]+"), lambda x: x != ""))
    kinds = F.array(
        F.struct(F.lit("plain").alias("measure"), F.col("bits")), F.struct(F.lit("cased").alias("measure"), cased.alias("bits"))
    )
    d = d.select("lang", "label", "doc_id", F.explode(kinds).alias("_k")).select("lang", "label", "doc_id", "_k.*")
    by = ["lang", "measure"]
    side = lambda v: S.distinct_sets(d.filter(F.col("label") == v), by, "doc_id", "bits")
    pairs = S.similar_sets(*together(lambda: side(1), lambda: side(0)), by, 1, 2)
    return A.threshold_table(pairs, "lang", _STEPS, {m: F.col("measure") == m for m in ("plain", "cased")})


@query("A7_distinct_entities", "SELECT count(DISTINCT trim(text)) AS n_entities FROM documents")
def a7(spark, sf):
    return table(spark, sf, "documents").agg(F.countDistinct(F.trim("text")).alias("n_entities"))


SQL_FENCES = f"""{SQL_TRADES}, long AS ({' UNION ALL '.join(f"SELECT '{p}' AS property, {p} AS value FROM trades" for p in TRADE_PROPS)}),
q AS (SELECT property, count(*) AS n_values, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS median, quantile_cont(value, 0.75) AS q3 FROM long GROUP BY property),
fences AS (SELECT *, q3 - q1 AS iqr, q1 - 1.5 * (q3 - q1) AS lower_fence, q3 + 1.5 * (q3 - q1) AS upper_fence FROM q),
flagged AS (SELECT t.*, {', '.join(f"{p} < (SELECT lower_fence FROM fences WHERE property = '{p}') OR {p} > (SELECT upper_fence FROM fences WHERE property = '{p}') AS o_{p}" for p in TRADE_PROPS)} FROM trades t)"""


@query(
    "A8_iqr_fences",
    f"""WITH {SQL_FENCES} SELECT property, n_values, round(q1, 6) AS q1, round(median, 6) AS median, round(q3, 6) AS q3, round(iqr, 6) AS iqr,
      round(lower_fence, 6) AS lower_fence, round(upper_fence, 6) AS upper_fence FROM fences""",
)
def a8(spark, sf):
    f = A.iqr_fences(trades(spark, sf), TRADE_PROPS)
    return rounded(f, "q1", "median", "q3", "iqr", "lower_fence", "upper_fence")


def flagged_trades(spark, sf):
    t = trades(spark, sf)
    return A.flag_outliers(t, A.iqr_fences(t, TRADE_PROPS), TRADE_PROPS)


SQL_ANY = " OR ".join(f"o_{p}" for p in TRADE_PROPS)


@query(
    "A9_outlier_split",
    f"WITH {SQL_FENCES} SELECT row_id, endpoint, CASE WHEN {SQL_ANY} THEN 'dropped' ELSE 'kept' END AS part FROM flagged",
)
def a9(spark, sf):
    return flagged_trades(spark, sf).select(
        "row_id", "endpoint", F.when(F.col("is_outlier"), "dropped").otherwise("kept").alias("part")
    )


@query(
    "A10_outlier_counts",
    f"""WITH {SQL_FENCES} SELECT CASE WHEN GROUPING(endpoint) = 1 THEN 'total' ELSE endpoint END AS endpoint, count(*) AS n_rows,
      count(*) FILTER ({SQL_ANY}) AS n_outliers, {', '.join(f"count(*) FILTER (o_{p}) AS n_{p}" for p in TRADE_PROPS)},
      round(count(*) FILTER ({SQL_ANY}) / count(*), 6) AS outlier_ratio FROM flagged GROUP BY ROLLUP (endpoint)""",
)
def a10(spark, sf):
    return rounded(A.outlier_counts(flagged_trades(spark, sf), TRADE_PROPS, "endpoint"), "outlier_ratio")


def sentence_lengths(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "lang", F.explode(fragments(F.col("text"))).alias("f"))
    return d.select("doc_id", "lang", F.length("f").cast("long").alias("len"))


SQL_LENGTHS = f"lengths AS (SELECT doc_id, lang, length(f) AS len FROM (SELECT doc_id, lang, unnest({SQL_FRAGMENTS.format('text')}) AS f FROM documents))"


@query(
    "A11_length_cut",
    f"""WITH {SQL_LENGTHS}, q AS (SELECT quantile_cont(len, 0.25) AS q1, quantile_cont(len, 0.5) AS median, quantile_cont(len, 0.75) AS q3 FROM lengths),
    c AS (SELECT *, q3 + 1.5 * (q3 - q1) AS upper_fence, CAST(floor(q3 + 1.5 * (q3 - q1)) AS BIGINT) + 1 AS cut FROM q)
    SELECT q1, median, q3, upper_fence, cut, count(*) AS n, count(*) FILTER (len >= cut) AS n_outliers, min(len) AS min, max(len) AS max,
      round(avg(len), 6) AS mean, round(count(*) FILTER (len >= cut) / count(*), 6) AS outlier_rate FROM lengths, c GROUP BY ALL""",
)
def a11(spark, sf):
    return rounded(A.length_cut(sentence_lengths(spark, sf), "len"), "mean", "outlier_rate")


@query(
    "A12_fragment_stats",
    f"""WITH {SQL_LENGTHS} SELECT lang, count(*) AS n, round(avg(len), 6) AS mean, round(stddev_pop(len), 6) AS std, min(len) AS min, max(len) AS max,
      quantile_cont(len, 0.25) AS p25, quantile_cont(len, 0.5) AS median, quantile_cont(len, 0.75) AS p75 FROM lengths GROUP BY lang""",
)
def a12(spark, sf):
    return rounded(A.describe(sentence_lengths(spark, sf), "len", ["lang"]), "mean", "std")


@query(
    "A12_length_bins",
    f"""WITH {SQL_LENGTHS} SELECT CASE WHEN len < 5 THEN '[0,5)' WHEN len < 10 THEN '[5,10)' WHEN len < 20 THEN '[10,20)' WHEN len < 50 THEN '[20,50)' ELSE '[50,10000]' END AS bin,
      count(*) AS n, count(DISTINCT doc_id) AS n_docs FROM lengths GROUP BY 1""",
)
def a12_bins(spark, sf):
    d = sentence_lengths(spark, sf)
    return d.groupBy(A.length_bin(F.col("len")).alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("doc_id").alias("n_docs")
    )


@query(
    "A13_fragment_count_distribution",
    f"SELECT lang, CAST(len({SQL_FRAGMENTS.format('text')}) AS INTEGER) AS n_fragments, count(*) AS n FROM documents GROUP BY ALL",
)
def a13(spark, sf):
    return table(spark, sf, "documents").groupBy("lang", F.size(fragments(F.col("text"))).alias("n_fragments")).agg(
        F.count(F.lit(1)).alias("n")
    )


@query(
    "A14_partner_stats",
    f"WITH {SQL_TRADES} SELECT endpoint, left_id, count(*) AS n_rows, count(DISTINCT right_id) AS n_partners FROM trades GROUP BY ALL",
)
def a14(spark, sf):
    return A.partner_stats(trades(spark, sf), "endpoint", "left_id", "right_id")


@query(
    "A14_many_partner_summary",
    f"""WITH {SQL_TRADES}, s AS (SELECT endpoint, left_id, count(*) AS n_rows, count(DISTINCT right_id) AS k FROM trades GROUP BY ALL)
    SELECT CASE WHEN GROUPING(endpoint) = 1 THEN 'total' ELSE endpoint END AS endpoint, sum(n_rows)::BIGINT AS total_rows, count(*) AS n_entities,
      count(*) FILTER (k >= 9) AS n_many, sum(CASE WHEN k >= 9 THEN n_rows ELSE 0 END)::BIGINT AS rows_from_many,
      round(sum(CASE WHEN k >= 9 THEN n_rows ELSE 0 END) / sum(n_rows), 6) AS ratio FROM s GROUP BY ROLLUP (endpoint)""",
)
def a14_summary(spark, sf):
    return rounded(A.many_partner_summary(trades(spark, sf), "endpoint", "left_id", "right_id", 9), "ratio")


@query(
    "A15_label_conflicts",
    f"WITH {SQL_TRADES} SELECT DISTINCT left_id AS entity FROM trades WHERE left_id IN (SELECT right_id FROM trades)",
)
def a15(spark, sf):
    t = trades(spark, sf).select(F.col("left_id").cast("string").alias("l"), F.col("right_id").cast("string").alias("r"))
    return conflicted_entities(t, "l", "r").select(F.col("entity").cast("long").alias("entity"))


@query(
    "A16_pair_census",
    f"""WITH {SQL_TRADES} SELECT dataset_name, endpoint, count(*) AS n_pairs, count(DISTINCT left_id) AS n_left, GROUPING(dataset_name, endpoint)::BIGINT AS grouping
    FROM trades GROUP BY GROUPING SETS ((dataset_name, endpoint), (dataset_name), (endpoint), ())""",
)
def a16(spark, sf):
    cols = ["dataset_name", "endpoint"]
    return A.census(trades(spark, sf), [cols, cols[:1], cols[1:], []], cols, "n_pairs", {"n_left": "left_id"})


@query(
    "A17_type_by_step",
    f"""WITH {SQL_KINDS}, k AS (SELECT CASE WHEN n_fg_diff > 0 AND n_stereo_diff > 0 THEN 'both' WHEN n_fg_diff > 0 THEN 'only_fg' WHEN n_stereo_diff > 0 THEN 'only_stereo' ELSE 'none' END AS diff_type,
      n_diff_features = 1 AS one FROM kinds) SELECT diff_type, count(*) FILTER (one) AS one_step, count(*) FILTER (NOT one) AS multi_step FROM k GROUP BY ALL""",
)
def a17(spark, sf):
    k = kinds(spark, sf).select(
        pair_type(F.col("n_fg_diff"), F.col("n_stereo_diff")).alias("diff_type"),
        pair_step(F.col("n_diff_features")).alias("step_num"),
    )
    return A.crosstab(k, "diff_type", "step_num", ["one_step", "multi_step"])


@query(
    "A18_split_census",
    f"""WITH {SQL_PREDICTIONS}, p AS (SELECT *, CASE WHEN conv_id % 5 = 0 THEN 'test' ELSE 'train' END AS split FROM predictions)
    SELECT split, task, repre, step, count(*) AS n_rows, count(DISTINCT dataset_name) AS n_datasets, count(DISTINCT endpoint) AS n_endpoints, count(DISTINCT id) AS n_sources,
      GROUPING(split, task, repre, step)::BIGINT AS grouping FROM p GROUP BY GROUPING SETS ((split), (split, task), (split, task, repre, step))""",
)
def a18(spark, sf):
    p = predictions(spark, sf).withColumn("split", F.when(F.col("conv_id") % 5 == 0, "test").otherwise("train"))
    distinct = {"n_datasets": "dataset_name", "n_endpoints": "endpoint", "n_sources": "id"}
    cols = ["split", "task", "repre", "step"]
    return A.census(p, [cols[:1], cols[:2], cols], cols, "n_rows", distinct)


@query(
    "A19_dataset_table",
    f"""WITH {SQL_PREDICTIONS} SELECT task, step, {', '.join(f"count(*) FILTER (dataset_name = 'set{i}') AS set{i}" for i in range(5))}, count(*) AS total FROM predictions GROUP BY task, step""",
)
def a19(spark, sf):
    return A.dataset_table(predictions(spark, sf), ["task", "step"], "dataset_name", [f"set{i}" for i in range(5)])


SQL_SPLIT_SUMMARY = """summary AS (SELECT p_type AS dataset_name, p_brand AS endpoint, count(*) AS n_total, count(*) FILTER (p_size % 10 < 7) AS n_train,
  count(*) FILTER (p_size % 10 = 7) AS n_valid, count(*) FILTER (p_size % 10 > 7) AS n_test FROM part GROUP BY ALL)"""


@query(
    "A20_split_summary",
    f"""WITH {SQL_SPLIT_SUMMARY}, g AS (SELECT dataset_name, count(*) AS n_endpoints, sum(n_total)::BIGINT AS sum_total, sum(n_train)::BIGINT AS sum_train, sum(n_valid)::BIGINT AS sum_valid, sum(n_test)::BIGINT AS sum_test,
      count(*) FILTER (n_total < 5) AS size_lt5, count(*) FILTER (n_total >= 5 AND n_total < 10) AS size_lt10, count(*) FILTER (n_total >= 10 AND n_total < 30) AS size_lt30,
      count(*) FILTER (n_total >= 30 AND n_total < 100) AS size_lt100, count(*) FILTER (n_total >= 100) AS size_ge100 FROM summary GROUP BY ALL)
    SELECT *, round(sum_train / sum_total, 6) AS train_ratio, round(sum_valid / sum_total, 6) AS valid_ratio, round(sum_test / sum_total, 6) AS test_ratio FROM g""",
)
def a20(spark, sf):
    r = F.col("p_size") % 10
    s = table(spark, sf, "part").groupBy(F.col("p_type").alias("dataset_name"), F.col("p_brand").alias("endpoint")).agg(
        F.count(F.lit(1)).alias("n_total"),
        F.count_if(r < 7).alias("n_train"),
        F.count_if(r == 7).alias("n_valid"),
        F.count_if(r > 7).alias("n_test"),
    )
    return rounded(A.split_summary(s), "train_ratio", "valid_ratio", "test_ratio")


@query(
    "A21_endpoint_table",
    f"WITH {SQL_TRADES} SELECT dataset_name, endpoint, count(*) AS n_pairs, count(DISTINCT left_id) AS n_pos, count(DISTINCT right_id) AS n_neg FROM trades GROUP BY ALL",
)
def a21(spark, sf):
    return trades(spark, sf).groupBy("dataset_name", "endpoint").agg(
        F.count(F.lit(1)).alias("n_pairs"), F.countDistinct("left_id").alias("n_pos"), F.countDistinct("right_id").alias("n_neg")
    )


SQL_SCORED = f"""{SQL_PREDICTIONS}, scored AS (SELECT *, CASE WHEN trim(pred) = trim(gold) THEN 1 ELSE 0 END AS correct,
  CASE WHEN length(pred) % 4 <> 0 THEN length(pred) % 3 / 2.0 END AS m1, CASE WHEN model = 'm1' THEN NULL ELSE length(gold) % 5 / 4.0 END AS m2,
  CASE WHEN length(pred) % 6 = 0 THEN 'empty' WHEN length(pred) % 6 = 1 THEN 'decode_failed:length' WHEN length(pred) % 6 = 2 THEN 'invalid:parse' END AS reason FROM predictions)"""


def scored(spark, sf):
    n, g = F.length("pred"), F.length("gold")
    return predictions(spark, sf).withColumns(
        {
            "correct": (F.trim("pred") == F.trim("gold")).cast("int"),
            "m1": F.when(n % 4 != 0, (n % 3) / 2.0),
            "m2": F.when(F.col("model") != "m1", (g % 5) / 4.0),
            "reason": F.when(n % 6 == 0, "empty").when(n % 6 == 1, "decode_failed:length").when(n % 6 == 2, "invalid:parse"),
        }
    )


@query(
    "A22_metric_means",
    f"""WITH {SQL_SCORED} SELECT task, repre, step, model, count(*) AS total, sum(correct)::BIGINT AS n_correct, round(sum(m1)::DOUBLE / count(*), 6) AS m1, round(sum(m2)::DOUBLE / count(*), 6) AS m2,
      round(sum(correct) / count(*), 6) AS accuracy FROM scored GROUP BY task, repre, step, model""",
)
def a22(spark, sf):
    return rounded(A.metric_means(scored(spark, sf), ["task", "repre", "step", "model"], ["m1", "m2"]), "m1", "m2", "accuracy")


@query("A23_reason_histogram", f"WITH {SQL_SCORED} SELECT task, model, reason, count(*) AS n FROM scored WHERE reason IS NOT NULL GROUP BY ALL")
def a23(spark, sf):
    return A.reason_histogram(scored(spark, sf), ["task", "model"])


@query(
    "A23_reason_examples",
    f"""WITH {SQL_SCORED} SELECT task, reason, id, n FROM (SELECT task, reason, id, CAST(row_number() OVER (PARTITION BY task, reason ORDER BY id) AS INTEGER) AS n FROM scored WHERE reason IS NOT NULL) WHERE n <= 24""",
)
def a23_examples(spark, sf):
    return A.reason_examples(scored(spark, sf), ["task", "reason"], ["id"]).select("task", "reason", "id", "n")


SQL_PAIRED = """count(*) AS n_paired, round(avg(t1_em), 6) AS mean_t1, round(avg(t2_em), 6) AS mean_t2, round(avg(t3_em), 6) AS mean_t3,
  round(avg(CASE WHEN t1_em IS NOT NULL AND t3_em IS NOT NULL THEN (t1_em = t3_em)::INT END), 6) AS agreement_t1,
  round(avg(CASE WHEN t2_em IS NOT NULL THEN (t2_em = CASE WHEN t3_bleu > 0.5 THEN 1 ELSE 0 END)::INT END), 6) AS agreement_t2,
  round(avg(t3_em) - avg(t1_em), 6) AS mean_delta_t1, round(avg(t3_bleu) - avg(t2_em), 6) AS mean_delta_t2, round(avg(meta_mismatch), 6) AS mismatch_rate"""
PAIRED = ("mean_t1", "mean_t2", "mean_t3", "agreement_t1", "agreement_t2", "mean_delta_t1", "mean_delta_t2", "mismatch_rate")


@query("A24_paired_summary", f"WITH {SQL_ALIGNED} SELECT dataset_name, {SQL_PAIRED} FROM aligned GROUP BY dataset_name")
def a24(spark, sf):
    return rounded(A.paired_summary(aligned_three(spark, sf), ["dataset_name"]), *PAIRED)


@query(
    "A25_outcome_table",
    f"""WITH {SQL_ALIGNED} SELECT endpoint, count(*) FILTER (t1_em = 1 AND t3_em = 1) AS both_1, count(*) FILTER (t1_em = 0 AND t3_em = 0) AS both_0,
      count(*) FILTER (t1_em = 1 AND t3_em = 0) AS first_only, count(*) FILTER (t1_em = 0 AND t3_em = 1) AS second_only,
      round(avg(t3_em) - avg(t1_em), 6) AS mean_delta FROM aligned GROUP BY endpoint""",
)
def a25(spark, sf):
    a, b = F.col("t1_em"), F.col("t3_em")
    return aligned_three(spark, sf).groupBy("endpoint").agg(
        *A.outcome_table(a, b), F.round(F.avg(b) - F.avg(a), 6).alias("mean_delta")
    )


SQL_USED = f"{SQL_ALIGNED}, used AS (SELECT dataset_name, t3_em::INT AS final, t1_em::INT AS s1, t2_em::INT AS s2 FROM aligned WHERE t1_em IS NOT NULL AND t2_em IS NOT NULL AND t3_em IS NOT NULL)"


def used(spark, sf):
    return aligned_three(spark, sf).select(
        "dataset_name", F.col("t3_em").alias("final"), F.col("t1_em").alias("s1"), F.col("t2_em").alias("s2")
    )


@query(
    "A26_joint_outcomes",
    f"""WITH {SQL_USED} SELECT *, round(count / sum(count) OVER (PARTITION BY dataset_name, final), 6) AS frac
    FROM (SELECT dataset_name, final, s1, s2, count(*) AS count FROM used GROUP BY ALL)""",
)
def a26(spark, sf):
    return A.joint_outcomes(used(spark, sf), ["dataset_name"], "final", ["s1", "s2"])


@query(
    "A26_marginal_outcomes",
    f"""WITH {SQL_USED}, l AS (SELECT dataset_name, final, 's1' AS step, s1 AS em FROM used UNION ALL SELECT dataset_name, final, 's2', s2 FROM used),
    g AS (SELECT * FROM (SELECT DISTINCT dataset_name FROM aligned), (SELECT unnest([0, 1]) AS final), (SELECT unnest(['s1', 's2']) AS step), (SELECT unnest([0, 1]) AS em)),
    c AS (SELECT dataset_name, final, step, em, count(*) AS n FROM l GROUP BY ALL), f AS (SELECT g.*, coalesce(n, 0) AS count FROM g LEFT JOIN c USING (dataset_name, final, step, em))
    SELECT dataset_name, final, step, em, count, coalesce(round(count / nullif(sum(count) OVER (PARTITION BY dataset_name, final, step), 0), 6), 0) AS frac FROM f""",
)
def a26_marginal(spark, sf):
    return A.marginal_outcomes(used(spark, sf), ["dataset_name"], "final", ["s1", "s2"])


@query(
    "A27_pooled",
    f"""WITH {SQL_ALIGNED}, m AS (SELECT model, endpoint, count(*) AS n_paired, avg(t1_em) AS mean_t1, avg(CASE WHEN model <> 'm0' THEN t3_em END) AS mean_t3 FROM aligned GROUP BY ALL)
    SELECT CASE WHEN GROUPING(endpoint) = 1 THEN 'all (pooled)' ELSE endpoint END AS endpoint, count(*) AS n_models, sum(n_paired)::BIGINT AS n_paired,
      round(sum(mean_t1 * n_paired) / sum(CASE WHEN mean_t1 IS NOT NULL THEN n_paired END), 6) AS mean_t1,
      round(sum(mean_t3 * n_paired) / sum(CASE WHEN mean_t3 IS NOT NULL THEN n_paired END), 6) AS mean_t3 FROM m GROUP BY ROLLUP (endpoint)""",
)
def a27(spark, sf):
    model = F.concat(F.lit("m"), (F.floor(F.col("id") / 100) % 3).cast("string"))  # id: conversation * 100 + part
    m = aligned_three(spark, sf).groupBy(model.alias("model"), "endpoint").agg(
        F.count(F.lit(1)).alias("n_paired"),
        F.avg("t1_em").alias("mean_t1"),
        F.avg(F.when(model != "m0", F.col("t3_em"))).alias("mean_t3"),
    )
    return rounded(A.pooled(m, "endpoint", "n_paired", ["mean_t1", "mean_t3"]), "mean_t1", "mean_t3")


def name_counts(spark, sf):
    counts = F.transform_values("fg_full", lambda k, v: F.size(v))
    return part_entities(spark, sf).select("p_partkey", counts.alias("counts"))


@query(
    "A28_top_vocabulary",
    f"WITH {SQL_PART_PAIRS} SELECT w AS name, count(*) AS n FROM (SELECT unnest(words) AS w FROM part_entities) GROUP BY w ORDER BY n DESC, name LIMIT 10",
)
def a28(spark, sf):
    return A.top_vocabulary(name_counts(spark, sf), "counts")


@query(
    "A28_feature_counts",
    f"WITH {SQL_PART_PAIRS} SELECT p_partkey, w AS name, CAST(count(*) AS INTEGER) AS n FROM (SELECT p_partkey, unnest(words) AS w FROM part_entities) GROUP BY ALL",
)
def a28_counts(spark, sf):
    return A.feature_counts(name_counts(spark, sf), "p_partkey", "counts")


@query(
    "A28_feature_matrix",
    f"""WITH {SQL_PART_PAIRS}, v AS (SELECT list(w ORDER BY w) AS names FROM (SELECT DISTINCT unnest(words) AS w FROM part_entities))
    SELECT p_partkey, array_to_string(list_transform(names, lambda n: len(list_filter(words, lambda w: w = n))), ',') AS vector, len(names) AS n_names FROM part_entities, v""",
)
def a28_matrix(spark, sf):
    """Counts over every name of the data, in alphabetical order."""
    d = name_counts(spark, sf)
    names = cut(A.vocabulary(d, "counts"))
    m = cut(A.sparse_matrix(d, "p_partkey", "counts", names))
    rows = A.dense_rows(m, "p_partkey").join(m.select("p_partkey", "n_names"), "p_partkey")
    return rows.select("p_partkey", F.array_join(F.col("vector").cast("array<string>"), ",").alias("vector"), "n_names")


@query(
    "A29_density_histogram",
    """WITH s AS (SELECT l_linestatus AS split, min(l_extendedprice) AS lo, max(l_extendedprice) AS hi, avg(l_extendedprice) AS mean, count(*) AS n FROM lineitem GROUP BY 1),
    b AS (SELECT l_linestatus AS split, CAST(least(floor((l_extendedprice - lo) / ((hi - lo) / 40)), 39) AS INTEGER) AS bin, (hi - lo) / 40 AS w, mean, s.n AS tot FROM lineitem JOIN s ON s.split = l_linestatus)
    SELECT split, bin, count(*) AS n, round(any_value(mean), 4) AS mean, round(count(*) / (any_value(tot) * any_value(w)), 12) AS density FROM b GROUP BY split, bin""",
)
def a29(spark, sf):
    li = table(spark, sf, "lineitem").select(F.col("l_linestatus").alias("split"), "l_extendedprice")
    d = A.density_histogram(li, "l_extendedprice", "split")
    return d.withColumns({"mean": F.round("mean", 4), "density": F.round("density", 12)})


@query(
    "A30_similarity_quantiles",
    f"""WITH {SQL_TURNS}, w AS (SELECT {SQL_WORDS.format('left_repr')} AS a, {SQL_WORDS.format('right_repr')} AS b FROM turns),
    s AS (SELECT len(list_intersect(a, b)) / (len(a) + len(b) - len(list_intersect(a, b))) AS sim FROM w)
    SELECT count(*) AS n, round(avg(sim), 6) AS mean, round(stddev_pop(sim), 6) AS std, round(min(sim), 6) AS min, round(max(sim), 6) AS max,
      round(quantile_cont(sim, 0.25), 6) AS p25, round(median(sim), 6) AS median, round(quantile_cont(sim, 0.75), 6) AS p75 FROM s""",
)
def a30(spark, sf):
    s = turns(spark, sf).select(tanimoto(words(F.col("left_repr")), words(F.col("right_repr"))).alias("sim"))
    return rounded(A.describe(s, "sim"), "mean", "std", "min", "max", "p25", "median", "p75")


@query(
    "A31_type_counts",
    f"""WITH {SQL_KINDS}, k AS (SELECT CASE WHEN n_fg_diff > 0 AND n_stereo_diff > 0 THEN 'both' WHEN n_fg_diff > 0 THEN 'only_fg' WHEN n_stereo_diff > 0 THEN 'only_stereo' ELSE 'none' END AS diff_type, n_diff_features AS d FROM kinds)
    SELECT diff_type, count(*) AS n, round(avg(d), 6) AS mean, round(stddev_pop(d), 6) AS std, min(d) AS min, max(d) AS max, quantile_cont(d, 0.25) AS p25, quantile_cont(d, 0.5) AS median, quantile_cont(d, 0.75) AS p75 FROM k GROUP BY diff_type""",
)
def a31(spark, sf):
    k = kinds(spark, sf).select(pair_type(F.col("n_fg_diff"), F.col("n_stereo_diff")).alias("diff_type"), "n_diff_features")
    return rounded(A.describe(k, "n_diff_features", ["diff_type"]), "mean", "std")
