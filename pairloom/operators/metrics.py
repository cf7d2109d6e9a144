"""Row metrics of stored predictions, per task, as column expressions.

Decoded forms come from a table with one row per distinct code: ``code, decoded, canon, bits_rdk,
bits_maccs, bits_morgan, error``; ``decoded`` is NULL where decoding failed, ``canon`` where the
decoded form is invalid. It is joined twice (prediction and gold) on the string.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairloom.functions.sets import fragments, tanimoto
from pairloom.functions.strings import (
    char_precision,
    exact_match,
    joined_parts,
    same_multiset,
    set_precision_recall_f1,
    text_or_empty,
)
from pairloom.operators.joins import attach_source_row
from pairloom.operators.ranking import relaxed_score, top_per_group
from pairloom.operators.skew import lookup, row_hash

BITS = ("rdk", "maccs", "morgan")


def decoded_as(df: DataFrame, column: str, table: DataFrame, prefix: str) -> DataFrame:
    """The decoded forms of a column's strings.

    A blank or NULL string decodes to nothing and stays out of the join, a frequent string is dealt over many
    tasks, and the table is broadcast only if counted to be small.
    """
    own = table.filter(F.trim("code") != "").select(
        F.col("code").alias("_code"),
        *[F.col(c).alias(f"{prefix}_{c}") for c in ("decoded", "canon", "error")],
        *[F.col(f"bits_{b}").alias(f"{prefix}_bits_{b}") for b in BITS],
    )
    asked = df.withColumn("_code", F.when(F.trim(column) != "", F.col(column)))
    return lookup(asked, own, ["_code"], row_hash(df)).drop("_code")


def fragment_metrics(gold: Column, pred: Column, multiset: bool = True) -> dict[str, Column]:
    """Fragment identification. Without ``multiset`` the exact match is on the text (first generation)."""
    em = same_multiset(gold, pred)
    if not multiset:
        em = F.when((F.trim(text_or_empty(gold)) != "") & (exact_match(gold, pred) == 1), 1.0).otherwise(0.0)
    prf = set_precision_recall_f1(gold, pred)
    return {"fragment_em": em, "fragment_bleu1": char_precision(gold, pred), **{f"fragment_{k}": v for k, v in prf.items()}}


def _similarities(both: Column, missing: Column | None) -> dict[str, Column]:
    out = {}
    for b in BITS:
        sim = F.when(both, tanimoto(F.col(f"p_bits_{b}"), F.col(f"g_bits_{b}")))
        out[f"{b}_fts"] = sim if missing is None else F.coalesce(sim, missing)
    return out


def entity_metrics(has_context: Column, pred: Column) -> dict[str, Column]:
    """Entity level of a rebuilt prediction; NULL without context, prediction or decoding."""
    use = has_context & (F.trim(text_or_empty(pred)) != "") & F.col("p_decoded").isNotNull()
    both = use & F.col("p_canon").isNotNull() & F.col("g_canon").isNotNull()
    return {
        "entity_em": F.when(both, (F.col("p_canon") == F.col("g_canon")).cast("double")),
        "entity_sim": F.when(both, tanimoto(F.col("p_bits_morgan"), F.col("g_bits_morgan"))),
        "entity_validity": F.when(use, F.col("p_canon").isNotNull().cast("double")),
    }


def generated_fragment_frame(df: DataFrame, decoded: DataFrame, multiset: bool = True) -> DataFrame:
    """Fragment generation: fragment metrics and the entity rebuilt from common parts + prediction.

    ``df``: gold, pred, common, gold_repr (NULL common/gold_repr means no context row).
    """
    has_context = F.col("gold_repr").isNotNull()
    d = df.withColumn("_full", F.when(has_context, joined_parts(F.col("common"), F.col("pred"))))
    d = decoded_as(decoded_as(d, "_full", decoded, "p"), "gold_repr", decoded, "g")
    m = fragment_metrics(F.col("gold"), F.col("pred"), multiset) | entity_metrics(has_context, F.col("pred"))
    return _finish(d, m)


def string_metrics(gold: Column, pred: Column) -> dict[str, Column]:
    both = F.col("p_canon").isNotNull() & F.col("g_canon").isNotNull()
    return {
        "exact_match": F.coalesce((F.col("p_canon") == F.col("g_canon")).cast("double"), F.lit(0.0)),
        "bleu": char_precision(gold, pred),
        "levenshtein": F.levenshtein(F.trim(text_or_empty(gold)), F.trim(text_or_empty(pred))).cast("double"),
        **_similarities(both, F.lit(0.0)),
        "validity": F.col("p_canon").isNotNull().cast("double"),
    }


def generated_string_frame(df: DataFrame, decoded: DataFrame) -> DataFrame:
    """String generation: ``df`` has gold and pred, both strings of the decoded table."""
    d = decoded_as(decoded_as(df, "pred", decoded, "p"), "gold", decoded, "g")
    return _finish(d, string_metrics(F.col("gold"), F.col("pred")))


def code_metrics(gold: Column, pred: Column) -> dict[str, Column]:
    both = F.col("p_canon").isNotNull() & F.col("g_canon").isNotNull()
    zero = F.lit(0.0)
    return {
        "code_em": exact_match(gold, pred).cast("double"),
        "exact_match": F.coalesce((F.col("p_canon") == F.col("g_canon")).cast("double"), zero),
        "bleu": F.coalesce(F.when(both, char_precision(F.col("g_canon"), F.col("p_canon"))), zero),
        "levenshtein": F.coalesce(F.when(both, F.levenshtein("g_canon", "p_canon").cast("double")), zero),
        **_similarities(both, zero),
        "validity": (F.col("p_decoded").isNotNull() & F.col("p_canon").isNotNull()).cast("double"),
    }


def generated_code_frame(df: DataFrame, decoded: DataFrame) -> DataFrame:
    """Encoded-form generation: metrics on decoded canonicals, 0 where either fails."""
    d = decoded_as(decoded_as(df, "pred", decoded, "p"), "gold", decoded, "g")
    return _finish(d, code_metrics(F.col("gold"), F.col("pred")))


def stepwise_frame(df: DataFrame, decoded: DataFrame, final: str = "string", key: str = "id") -> DataFrame:
    """Three-part records: step1 and step2 fragments, final string or code; columns are prefixed.

    ``df``: key, gold, pred (final answers), gold_step1, pred_step1, gold_step2, pred_step2, common, gold_repr.
    """
    one = fragment_metrics(F.col("gold_step1"), F.col("pred_step1"))
    first = df.select(key, *[c.alias(f"step1_{n}") for n, c in one.items()])
    second = generated_fragment_frame(
        df.select(key, F.col("gold_step2").alias("gold"), F.col("pred_step2").alias("pred"), "common", "gold_repr"), decoded
    ).drop("gold", "pred", "common", "gold_repr")
    second = second.select(key, *[F.col(c).alias(f"step2_{c}") for c in second.columns if c != key])
    frame = generated_string_frame if final == "string" else generated_code_frame
    last = frame(df.select(key, "gold", "pred"), decoded).drop("gold", "pred")
    return first.join(second, key).join(last, key)


def string_to_code_frame(df: DataFrame, decoded: DataFrame) -> DataFrame:
    """String to code: code text metrics and the decoded prediction against the input string ``ref``."""
    d = decoded_as(decoded_as(df, "pred", decoded, "p"), "ref", decoded, "g")
    gold, pred = F.col("gold"), F.col("pred")
    dist = F.levenshtein(F.trim(text_or_empty(gold)), F.trim(text_or_empty(pred))).cast("double")
    longest = F.greatest(F.length(F.trim(text_or_empty(gold))), F.length(F.trim(text_or_empty(pred))), F.lit(1))
    m = {
        "em": F.when((F.trim(text_or_empty(gold)) != "") & (exact_match(gold, pred) == 1), 1.0).otherwise(0.0),
        "bleu1": char_precision(gold, pred),
        "validity": F.col("p_canon").isNotNull().cast("double"),
        "lev": dist,
        "lev_norm": 1.0 - dist / longest,
        **entity_metrics(F.trim(text_or_empty(F.col("ref"))) != "", pred),
    }
    return _finish(d, m)


def _finish(d: DataFrame, metrics: Mapping[str, Column]) -> DataFrame:
    used = [c for c in d.columns if c.startswith(("p_decoded", "p_canon", "p_error", "p_bits", "g_decoded", "g_canon", "g_error", "g_bits"))]
    return d.withColumns(dict(metrics)).drop("_full", *used)


def validity_reason(df: DataFrame, decoded: DataFrame) -> DataFrame:
    """``reason`` of an invalid prediction: empty, decode_failed:<why>, invalid:<why>; NULL if valid."""
    d = decoded_as(df, "pred", decoded, "p")
    why = F.coalesce("p_error", F.lit("unknown"))
    reason = (
        F.when(F.trim(text_or_empty(F.col("pred"))) == "", "empty")
        .when(F.col("p_decoded").isNull(), F.concat(F.lit("decode_failed:"), why))
        .when(F.col("p_canon").isNull(), F.concat(F.lit("invalid:"), why))
    )
    return _finish(d, {"reason": reason})


def long_metrics(frames: Mapping[str, DataFrame], keys: Sequence[str]) -> DataFrame:
    """Task frames with different metrics as one long table: task, keys, metric, value."""
    parts = []
    for task, df in frames.items():
        numeric = [c for c, t in df.dtypes if t == "double" and c not in keys]
        parts.append(
            df.select(*keys, *numeric)
            .unpivot(list(keys), numeric, "metric", "value")
            .withColumn("task", F.lit(task))
        )
    return reduce(lambda a, b: a.unionByName(b), parts)


def evaluation_summary(long: DataFrame, by: Sequence[str]) -> DataFrame:
    """Metric means over all rows of a group (missing values stay in the denominator)."""
    return long.groupBy(*by, "metric").agg(
        F.count(F.lit(1)).alias("total"), (F.sum("value") / F.count(F.lit(1))).alias("mean")
    )


#: task -> (its frame, the metric that says whether a prediction is correct)
TASK_FRAMES = {
    "identify": (lambda d, decoded: d.withColumns(fragment_metrics(F.col("gold"), F.col("pred"))), "fragment_em"),
    "generate": (generated_fragment_frame, "fragment_em"),
    "first": (lambda d, decoded: generated_fragment_frame(d, decoded, multiset=False), "fragment_em"),
    "rewrite": (generated_string_frame, "exact_match"),
    "rewrite_code": (generated_code_frame, "exact_match"),
    "stepwise": (stepwise_frame, "exact_match"),
    "stepwise_code": (lambda d, decoded: stepwise_frame(d, decoded, "code"), "exact_match"),
    "code": (string_to_code_frame, "em"),
}


def evaluate(tasks: Mapping[str, DataFrame], decoded: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Each task's predictions by its own frame: task, keys, total, correct, accuracy."""
    unknown = sorted(set(tasks) - set(TASK_FRAMES))
    if unknown:
        raise ValueError(f"unknown tasks: {', '.join(unknown)}")
    parts = []
    for task, df in tasks.items():
        frame, main = TASK_FRAMES[task]
        hit = F.coalesce((F.col(main) == 1).cast("long"), F.lit(0))
        parts.append(frame(df, decoded).select(F.lit(task).alias("task"), *keys, hit.alias("_hit")))
    both = reduce(lambda a, b: a.unionByName(b), parts)
    out = both.groupBy("task", *keys).agg(F.count(F.lit(1)).alias("total"), F.sum("_hit").alias("correct"))
    return out.withColumn("accuracy", F.col("correct") / F.col("total"))


def report_table(summary: DataFrame, rows: DataFrame, by: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """One line per expected row, metrics as columns; expected rows without results stay empty."""
    wide = summary.groupBy(*by).pivot("metric", list(metrics)).agg(F.first("mean"))
    return rows.select(*by).join(wide, list(by), "left")


def correct_answer(gold: Column, pred: Column, given: Column | None = None) -> Column:
    """A stored verdict if there is one, else whether the answers agree apart from case and outer blanks."""
    def plain(c: Column) -> Column:
        return F.upper(F.trim(text_or_empty(c)))

    same = plain(gold) == plain(pred)
    return same if given is None else F.coalesce(given.cast("int") == 1, same)


CASE_FEATURES = ("sim", "shared_atoms", "shared_bonds", "atom_gap", "bond_gap", "ring_gap", "only_left", "only_right")


def best_cases(
    predictions: DataFrame, features: DataFrame, k: int = 2, gate: float = 0.62, show: Sequence[str] = (), ties: Sequence[str] = ()
) -> DataFrame:
    """The k best correct predictions of each task, step and model by the pair's relaxed score.

    ``predictions``: source_index, task, step, model, gold, pred, optionally correct; ``features``: a row per
    source_index with :data:`CASE_FEATURES` (atom and bond gaps as ratios) and ``show``. Pairs below the gate are left
    out, and in single steps those with other than one changed fragment a side. Equal scores go by source_index
    and ``ties``.
    """
    given = F.col("correct") if "correct" in predictions.columns else None
    right = predictions.filter(correct_answer(F.col("gold"), F.col("pred"), given))
    d = attach_source_row(right, features, [*CASE_FEATURES, *show]).filter(F.col("sim") >= gate)
    one_each = (F.size(fragments("only_left")) == 1) & (F.size(fragments("only_right")) == 1)
    d = d.filter((F.col("step") != "single_step") | one_each)
    d = d.withColumn("score", relaxed_score(*[F.col(c) for c in CASE_FEATURES[:6]]))
    return top_per_group(d, ["task", "step", "model"], [F.desc("score"), F.col("source_index"), *[F.col(c) for c in ties]], k)


def flatten(df: DataFrame, nested: Mapping[str, Sequence[str]]) -> DataFrame:
    """Struct fields as ``<struct>_<field>`` columns."""
    cols = [c for c in df.columns if c not in nested]
    return df.select(*cols, *[F.col(f"{s}.{f}").alias(f"{s}_{f}") for s, fs in nested.items() for f in fs])
