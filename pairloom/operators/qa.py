"""Question/answer tables from the pair table.

Templates are data: text with ``{column}`` slots, rendered by one ``concat`` per row. A task names
its question template and the columns of its answer.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairloom.operators.choices import letter
from pairloom.operators.filters import drop_unplaced, step_of_fragments
from pairloom.operators.ranking import shuffled_ids
from pairloom.operators.rowdiff import (
    names_on_one_side,
    plan_records,
    plan_text,
    position_changed_names,
    site_list,
    unique_stereo,
)

VARIANTS = ("only_text", "only_code", "both_repre")


def render(template: str, slots: Mapping[str, Column] | None = None) -> Column:
    """``{name}`` slots are filled with ``slots`` or the columns of that name; NULL becomes an empty string."""
    parts = []
    for i, piece in enumerate(re.split(r"\{(\w+)\}", template)):
        if i % 2:
            value = (slots or {}).get(piece, F.col(piece))
            parts.append(F.coalesce(value.cast("string"), F.lit("")))
        elif piece:
            parts.append(F.lit(piece))
    return F.concat(*parts)


@dataclass(frozen=True)
class Task:
    name: str
    question: str
    answer: Mapping[str, str]  # answer field -> column
    step_from: Sequence[str] = ("only_left", "only_right")


TASKS = (
    Task("identify", "{context}\nWhich parts of the active entity {shown} cause its label?", {"answer": "only_left"}, ("only_left",)),
    Task("generate", "{context}\nActive entity: {shown}\nParts to replace: {only_left}\nGive the replacing parts.", {"answer": "only_right"}),
    Task("rewrite", "{context}\nActive entity: {shown}\nWrite the inactive counterpart.", {"answer": "right_repr"}),
    Task("rewrite_code", "{context}\nActive entity: {shown}\nWrite the code of the inactive counterpart.", {"answer": "right_code"}),
    Task("instructed", "{context}\nActive entity: {shown}\n{instruction}", {"answer": "right_repr"}),
    Task(
        "stepwise",
        "{context}\nActive entity: {shown}\nName the parts to replace, the replacing parts, and the counterpart.",
        {"answer": "right_repr", "step1": "only_left", "step2": "only_right"},
    ),
    Task(
        "stepwise_code",
        "{context}\nActive entity: {shown}\nName the parts to replace, the replacing parts, and the counterpart's code.",
        {"answer": "right_code", "step1": "only_left", "step2": "only_right"},
    ),
)


def representation(text: str, code: str, variant: Column) -> Column:
    """The entity as shown in a question, by variant; empty where the form is missing."""
    t, c = (F.trim(F.coalesce(F.col(x), F.lit(""))) for x in (text, code))
    only_text = F.when(t != "", F.concat(F.lit("TEXT = '"), t, F.lit("'"))).otherwise("")
    only_code = F.when(c != "", F.concat(F.lit("CODE = '"), c, F.lit("'"))).otherwise("")
    both = F.when((t != "") | (c != ""), F.concat(F.lit("TEXT = '"), t, F.lit("', CODE = '"), c, F.lit("'"))).otherwise("")
    return F.when(variant == VARIANTS[0], only_text).when(variant == VARIANTS[1], only_code).otherwise(both)


def with_variants(df: DataFrame) -> DataFrame:
    """One row per representation variant."""
    return df.withColumn("repre", F.explode(F.array(*[F.lit(v) for v in VARIANTS])))


def with_context(df: DataFrame, descriptions: DataFrame, fallback: str) -> DataFrame:
    """Description of the endpoint, else of the dataset, else the fallback text.

    ``descriptions``: dataset_name, endpoint (NULL for the dataset's own), text.
    """
    own = descriptions.filter(F.col("endpoint").isNotNull()).groupBy("dataset_name", "endpoint").agg(F.max("text").alias("_e"))
    base = descriptions.filter(F.col("endpoint").isNull()).groupBy("dataset_name").agg(F.max("text").alias("_d"))
    d = df.join(own, ["dataset_name", "endpoint"], "left").join(base, "dataset_name", "left")
    return d.withColumn("context", F.coalesce("_e", "_d", F.lit(fallback))).drop("_e", "_d")


def instruction(removed: Column, added: Column, step: Column) -> Column:
    """The edit in words: one part for another, or several in turn."""
    several = F.when(step == "single_step", "Swap '").otherwise("Swap, one after the other, '")
    return F.concat(several, removed, F.lit("' for '"), added, F.lit("'."))


def _record(task: Task) -> Column:
    """step, question and answer (JSON) of one task as a struct of the row's columns."""
    step = step_of_fragments(*[F.col(c) for c in task.step_from])
    slots = {"instruction": instruction(F.col("only_left"), F.col("only_right"), step)}
    answer = F.to_json(F.struct(*[F.coalesce(F.col(c), F.lit("")).alias(f) for f, c in task.answer.items()]))
    return F.struct(
        F.lit(task.name).alias("task"), step.alias("step"), render(task.question, slots).alias("question"), answer.alias("answer")
    )


def task_records(df: DataFrame, tasks: Sequence[Task] = TASKS) -> DataFrame:
    """id-less records of all tasks, fanned out of one pass over the rows.

    ``df``: context, shown, the tasks' columns, dataset_name, endpoint, source_index, repre. Rows
    lacking both dataset and endpoint are left out. Gives task, repre, step, question, answer, dataset_name,
    endpoint, source_index.
    """
    d = drop_unplaced(df).withColumn("_task", F.explode(F.array(*[_record(t) for t in tasks])))
    return d.select("_task.task", "repre", "_task.step", "_task.question", "_task.answer", "dataset_name", "endpoint", "source_index")


def task_tables(df: DataFrame, seed: int, tasks: Sequence[Task] = TASKS) -> DataFrame:
    """All tasks with ids 0..n-1 per (task, representation, step) in a seeded order."""
    return shuffled_ids(task_records(df, tasks), seed, F.col("source_index"), ["task", "repre", "step"])


def code_tables(df: DataFrame, split: str | None = None) -> DataFrame:
    """Code to string and string to code records; rows without a code are left out."""
    d = df if split is None else df.filter(F.col("split") == split)
    d = d.filter(F.trim(F.coalesce("code", F.lit(""))) != "")
    to_text = d.select(F.lit("code_to_text").alias("task"), "key", F.concat(F.lit("Decode: "), "code").alias("question"), F.col("text").alias("answer"))
    to_code = d.select(F.lit("text_to_code").alias("task"), "key", F.concat(F.lit("Encode: "), "text").alias("question"), F.col("code").alias("answer"))
    return to_text.unionByName(to_code)


def shot_variants(df: DataFrame, examples: str, counts: Sequence[int] = (1, 2, 4)) -> DataFrame:
    """One row per number of examples, cut from the same ranked list."""
    d = df.withColumn("shots", F.explode(F.array(*[F.lit(c) for c in counts])))
    return d.withColumn(examples, F.slice(F.col(examples), F.lit(1), F.col("shots")))


def choice_table(df: DataFrame) -> DataFrame:
    """Lettered options and the answer's letter; ``df`` as from ``choices.with_distractors``."""
    lines = F.transform("choices", lambda v, i: F.concat(letter(i), F.lit(". "), v))
    return df.select(
        "id", F.array_join(lines, "\n").alias("options"), letter(F.col("answer_index")).alias("letter"), "answer_index"
    )


def aligned_tables(tasks: Mapping[str, DataFrame], seed: int, key: str = "source_index") -> DataFrame:
    """The same ordered ids over all tasks: one id list from the common keys joined to each table."""
    frames = list(tasks.values())
    ids = frames[0].select(key).distinct()
    for f in frames[1:]:
        ids = ids.join(f.select(key), key, "left_semi")
    ids = shuffled_ids(ids, seed, F.col(key))
    parts = [f.join(ids, key).withColumn("task", F.lit(name)) for name, f in tasks.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def split_overlap(df: DataFrame, key: str) -> DataFrame:
    """Per task: keys in train, in test and in both (leakage audit)."""
    sides = df.groupBy("task", key).agg(
        F.max((F.col("split") == "train").cast("int")).alias("tr"), F.max((F.col("split") == "test").cast("int")).alias("te")
    )
    return sides.groupBy("task").agg(
        F.sum("tr").alias("n_train"),
        F.sum("te").alias("n_test"),
        F.sum(F.col("tr") * F.col("te")).alias("n_both"),
    )


def multi_answer_questions(df: DataFrame, question: str, answer: str) -> DataFrame:
    """Questions with more than one distinct answer."""
    d = df.groupBy(question).agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct(answer).alias("n_answers"))
    return d.filter("n_answers > 1")


# --- feature-difference tasks ----------------------------------------------------------------------


def named_differences(df: DataFrame) -> DataFrame:
    """``left_names`` and ``right_names`` of the feature tasks, and the moved shared names.

    Left names fall back to moved names and then to the right side's names.
    """
    left, right, moved = names_on_one_side("left", "right"), names_on_one_side("right", "left"), position_changed_names()

    def some(c: Column) -> Column:
        return F.when(F.size(c) > 0, c)

    d = df.withColumn("own_left", left).withColumn("right_names", right).withColumn("moved", moved)
    return d.withColumn("left_names", F.coalesce(some(F.col("own_left")), some(F.col("moved")), F.col("right_names")))


def _positions(side: str, names: Column) -> Column:
    """(name, position group) rows of the side's map."""
    return F.flatten(
        F.transform(
            names,
            lambda n: F.transform(
                F.coalesce(F.col(f"{side}_fg_full")[n], F.array().cast("array<array<int>>")),
                lambda p: F.struct(n.alias("name"), p.alias("indices")),
            ),
        )
    )


def _placed(side: str, names: Column) -> Column:
    """Records (name, places) of names, without places where the side has none."""
    none = F.array().cast("array<array<int>>")
    return F.transform(names, lambda n: F.struct(n.alias("name"), F.coalesce(F.col(f"{side}_fg_full")[n], none).alias("places")))


def _edits(left: Column, right: Column) -> Column:
    """The exchange as signed names: ``-old +new``."""
    signed = lambda sign, names: F.transform(names, lambda n: F.concat(F.lit(sign), n))
    return F.array_join(F.concat(signed("-", left), signed("+", right)), " ")


def _listed(side: str, names: Column) -> Column:
    """``name at 1, 4`` for each name, in one line."""
    one = lambda r: F.concat(r["name"], F.lit(" at "), F.array_join(F.flatten(r["places"]), ", "))
    return F.array_join(F.transform(_placed(side, names), one), "; ")


def fg_records() -> dict[str, tuple[Column, Column, Column]]:
    """kind -> (condition, question, JSON answer) of the feature-name kinds, over :func:`named_differences` columns."""
    left, right = F.col("left_names"), F.col("right_names")
    shown = F.array_join(F.sort_array(F.array_distinct(F.concat(F.map_keys("left_fg_full"), F.map_keys("right_fg_full")))), ", ")
    head = F.concat(F.lit("Pair: "), "left_repr", F.lit(" | "), "right_repr", F.lit("\nNames: "), shown)
    named = F.size(left) > 0
    # both sides need something to name; the right side falls back to moved names, then the left's
    some = F.coalesce(F.when(F.size(right) > 0, right), F.when(F.size("moved") > 0, F.col("moved")), left)
    exchange = F.concat(head, F.lit("\nOut: "), _listed("left", left), F.lit("\nIn: "), _listed("right", some))
    plan = F.struct(_placed("left", left).alias("out"), _placed("right", right).alias("in"), _edits(left, right).alias("edits"))
    target = F.col("right_repr").alias("target")
    return {
        "identify": (named, head, F.to_json(F.struct(left.alias("answer")))),
        "localise": (named, head, F.to_json(F.struct(_positions("left", left).alias("sites")))),
        "plan": (named, head, F.to_json(plan)),
        "repair": (named, head, F.to_json(F.struct(target, _edits(left, right).alias("edits")))),
        "remove_add": (named & (F.size(some) > 0), exchange, F.to_json(F.struct(target))),
    }


def stereo_records() -> dict[str, tuple[Column, Column, Column]]:
    """kind -> (condition, question, JSON answer) of the stereo kinds, over :func:`plan_records` columns."""
    size = F.lit(0)
    for side in ("left", "right"):
        size = size + F.size(f"{side}_chiral_centers") + F.size(f"{side}_ez_bonds")
    head = F.concat(F.lit("Pair: "), "left_repr", F.lit(" | "), "right_repr")
    own, other = unique_stereo("left", "right"), unique_stereo("right", "left")
    shown = F.when(F.size(own) > 0, own).otherwise(other)
    target = F.to_json(F.struct(F.col("right_repr").alias("target")))
    out = {
        "identify": (F.size(shown) > 0, head, F.to_json(F.struct(shown.alias("answer")))),
        "localise": (size > 0, head, F.to_json(F.struct(site_list().alias("sites")))),
        "plan": (size > 0, head, F.to_json(F.struct("removed", "added", "strategy"))),
    }
    for kind, wish in (("repair", "Differences:"), ("remove_add", "Edits to make:")):
        out[kind] = (size > 0, F.concat(head, F.lit(f"\n{wish}\n"), plan_text()), target)
    return out


KINDS = ("identify", "localise", "plan", "repair", "remove_add")
STEPS = ("one_step", "multi_step")
# 2 styles x 5 kinds x 2 steps
REGISTRY = tuple((style, kind, step) for style in ("only_fg", "only_stereo") for kind in KINDS for step in STEPS)


def _fanned(typed: DataFrame, wanted: Sequence[tuple[str, str]], key: str) -> DataFrame:
    """Records of (style, kind) tasks, all from one pass over the typed pair table."""
    d = plan_records(named_differences(typed.filter(F.col("diff_type").isin(*{style for style, _ in wanted}))))
    makers = {"only_fg": fg_records(), "only_stereo": stereo_records()}
    records = []
    for style, kind in wanted:
        applies, question, answer = makers[style][kind]
        record = F.struct(F.lit(style).alias("style"), F.lit(kind).alias("kind"), question.alias("question"), answer.alias("answer"))
        records.append(F.when((F.col("diff_type") == style) & applies, record))
    d = d.withColumn("_task", F.explode(F.array(*records))).filter(F.col("_task").isNotNull())
    name = F.concat("_task.style", F.lit("_"), "_task.kind", F.lit("_"), "step_num", F.lit("_"), F.col(key).cast("string"))
    return d.select(
        name.alias("qa_id"), "_task.style", "_task.kind", "step_num", "_task.question", "_task.answer", "dataset_name", "endpoint", key
    )


def difference_task(typed: DataFrame, style: str, kind: str, step: str | None = None, limit: int | None = None, key: str = "pair_id") -> DataFrame:
    """One registered task over the typed pair table; ``limit`` keeps the first rows by key."""
    out = _fanned(typed if step is None else typed.filter(F.col("step_num") == step), [(style, kind)], key)
    return out.orderBy(key).limit(limit) if limit else out


def difference_tasks(typed: DataFrame) -> DataFrame:
    """All registered tasks in one table."""
    return _fanned(typed, [(style, kind) for style in ("only_fg", "only_stereo") for kind in KINDS], "pair_id")
