"""Conversation structure repair as a lightest derivation, found with an agenda (Knuth's generalised Dijkstra).

Items say what has been derived, edits are axioms, and each deduction joins two premises:

    at(i, q)                 the first i rows are dealt with and the roles so far put the grammar in state q
    at(i, q), edit  =>  at(j, r)

A derivation weighs (cost, audit): costs add and audits (the edits' initials in order) are joined. Both functions are
superior and monotone: no conclusion is lighter than a premise, and a heavier premise never makes a lighter
conclusion (of two audits of one item and one cost none starts the other, for only insertions make an audit longer
and they cost). So the first time an item is popped its weight is final, and the search ends with the goal,
which is all rows dealt with in an accepting state of ``(s?(ua)+)?``.

A conversation of up to ``block`` rows is one agenda. A longer one is never held by one task: its rows get exact
positions by a range shuffle and are cut into blocks; each block is solved for every state it may begin in,

    span(l, m, p, r), span(m, h, r, q)  =>  span(l, h, p, q)

joins neighbouring blocks by the same agenda until the whole span is the goal, and the blocks' own parts
of the derivation go back to the blocks' rows. Only the digest of the repaired text passes one task, as a stream of
blocks in order, because a digest is sequential. The audit of a conversation must fit a string.

Defined results. NULL role, text, conv_id or turn counts as one space where text is built from it (the damage
key, the role, the text); rows of a NULL conv_id are one conversation and it is returned. Rows of one turn
follow role and text, so repeated rows stay side by side and all but the first are duplicates. Empty tables
give an empty result. Further columns of the input, whatever their names, are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from pairloom.llm.common import importable, staged
from pairloom.operators.ordering import attach, ordered_index
from pairloom.operators.skew import BROADCAST_KEYS, grid_join
from pairloom.session import cut

BLOCK = 512  # rows that one agenda takes
SPACE = " \t\n\v\f\r"
ENDS = (".", "!", "?")
# states of the grammar: nothing said, after the system row, after a user row, after an assistant row
START, SYSTEM, USER, ASSISTANT = range(4)
ACCEPTING = (START, ASSISTANT)
NEXT = {
    "s": {START: SYSTEM},
    "u": {START: USER, SYSTEM: USER, ASSISTANT: USER},
    "a": {USER: ASSISTANT},
}
LEGAL = ("su", "ua", "au")
# costs and initials of the edits: fixed values
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1

Weight = tuple[int, str]


def lightest(
    axioms: Iterable[tuple[int, str, tuple, tuple | None]],
    deduce: Callable[[tuple, dict], Iterable[tuple[int, str, tuple, tuple | None]]],
    goal: Callable[[tuple], bool] = lambda item: False,
) -> tuple[tuple | None, dict]:
    """Pops items by (cost, audit) until a goal item is final; returns it and the chart of all final items.

    ``deduce(item, chart)`` gives (cost, audit, conclusion, premises) of all deductions that ``item`` completes
    together with items that are final already. Without a goal every derivable item becomes final.
    """
    agenda = []
    chart: dict[tuple, tuple[int, str, tuple | None]] = {}
    n = 0
    for cost, audit, item, why in axioms:
        agenda.append((cost, audit, n, item, why))
        n += 1
    heapq.heapify(agenda)
    while agenda:
        cost, audit, _, item, why = heapq.heappop(agenda)
        if item in chart:
            continue
        chart[item] = (cost, audit, why)
        if goal(item):
            return item, chart
        for cost, audit, item, why in deduce(item, chart):
            if item not in chart:
                heapq.heappush(agenda, (cost, audit, n, item, why))
                n += 1
    return None, chart


def fault(text: str, repeated: bool) -> str:
    bare = text.rstrip(SPACE)
    if not bare:
        return "blank"
    if repeated:
        return "duplicate"
    return "" if bare.endswith(ENDS) else "truncated"


def edits(faults: list[str], roles: list[str]) -> Callable[[tuple, dict], Iterator[tuple]]:
    """Deductions from at(i, q): insertions, and what can be done with row i."""
    rows = len(faults)

    def deduce(item: tuple, chart: dict) -> Iterator[tuple]:
        i, q = item
        cost, audit, _ = chart[item]
        said = ASSISTANT if q == USER else USER  # the only role that can be made here
        yield cost + INSERT, audit + "I", (i, said), None
        if i == rows:
            return
        yield cost + DELETE, audit + "D", (i + 1, q), None
        kind = faults[i]
        if kind in ("blank", "duplicate"):
            return
        extra = TRUNCATED if kind else 0
        kept = NEXT.get(roles[i][:1], {}).get(q)
        if kept is not None:
            yield cost + KEEP + extra, audit + "K", (i + 1, kept), None
        yield cost + REROLE + extra, audit + "R", (i + 1, said), None

    return deduce


def repair(faults: list[str], roles: list[str]) -> Weight:
    """The lightest edits of a whole conversation."""
    rows = len(faults)
    goal, chart = lightest(
        [(0, "", (0, START), None)], edits(faults, roles), lambda item: item[0] == rows and item[1] in ACCEPTING
    )
    return chart[goal][:2]


def block_spans(faults: list[str], roles: list[str]) -> list[tuple[int, int, int, str]]:
    """(first state, last state, cost, audit) of the lightest edits of a block between any two states."""
    rows, out = len(faults), []
    for p in range(4):
        _, chart = lightest([(0, "", (0, p), None)], edits(faults, roles))
        out += [(p, q, *chart[(rows, q)][:2]) for q in range(4) if (rows, q) in chart]
    return out


def join_spans(blocks: list[list[tuple[int, int, int, str]]]) -> tuple[Weight, list[tuple[int, str]]]:
    """Weight of the whole conversation and, for each block, its first state and its part of the audit."""
    sizes = [len(blocks)]
    while sizes[-1] > 1:
        sizes.append((sizes[-1] + 1) // 2)
    top = len(sizes) - 1
    ending: dict[tuple, set[int]] = {}  # (level, k, side, state) -> states at the other end of final spans

    def deduce(item: tuple, chart: dict) -> Iterator[tuple]:
        level, k, p, q = item
        ending.setdefault((level, k, "from", p), set()).add(q)
        ending.setdefault((level, k, "to", q), set()).add(p)
        if level == top:
            return
        cost, audit, _ = chart[item]
        if k % 2 == 0 and k + 1 == sizes[level]:
            yield cost, audit, (level + 1, k // 2, p, q), (item,)
        elif k % 2 == 0:
            for r in ending.get((level, k + 1, "from", q), ()):
                right = (level, k + 1, q, r)
                yield cost + chart[right][0], audit + chart[right][1], (level + 1, k // 2, p, r), (item, right)
        else:
            for r in ending.get((level, k - 1, "to", p), ()):
                left = (level, k - 1, r, p)
                yield chart[left][0] + cost, chart[left][1] + audit, (level + 1, k // 2, r, q), (left, item)

    axioms = [(c, a, (0, k, p, q), None) for k, spans in enumerate(blocks) for p, q, c, a in spans if k or p == START]
    goal, chart = lightest(
        axioms, deduce, lambda item: item[0] == top and item[2] == START and item[3] in ACCEPTING
    )
    parts, open_ = [], [goal]
    while open_:
        item = open_.pop()
        _, audit, why = chart[item]
        if why is None:
            parts.append((item[2], audit))
        else:
            open_.extend(reversed(why))
    return chart[goal][:2], parts


def repaired(rows: Iterable[tuple[str, str]], audit: str, state: int = START) -> Iterator[str]:
    """``role:text`` of the repaired rows; ``rows`` are the (role, text) the audit was made for."""
    rows = iter(rows)
    for letter in audit:
        if letter == "D":
            next(rows)
            continue
        role, text = ("", "") if letter == "I" else next(rows)
        if letter != "K":
            role = "assistant" if state == USER else "user"
        state = NEXT[role[:1]][state]
        yield f"{role}:{text}"


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, gone: the contract's faults put into the rows (``gone`` rows are dropped)."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    code = F.crc32(F.concat(blank("conv_id"), F.lit(":"), blank("turn")).cast("binary")) % 20
    text = (
        F.when(code == 1, F.lit("")).when(code == 2, F.regexp_replace(blank("text"), "[.!?]", "")).otherwise(blank("text"))
    )
    rows = conversations.select(
        "conv_id",
        F.col("turn").cast("long").alias("turn"),
        F.when(code == 4, F.lit("user")).otherwise(blank("role")).alias("role"),
        text.alias("text"),
        (code == 0).alias("gone"),
        F.explode(F.when(code == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
    )
    return rows.drop("copy")


def as_is(conversations: DataFrame) -> DataFrame:
    """The rows as they are, for repairing real conversations."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    return conversations.select(
        "conv_id", F.col("turn").cast("long").alias("turn"), blank("role").alias("role"), blank("text").alias("text"),
        F.lit(False).alias("gone"),
    )


def _groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, list[tuple]]]:
    """Rows of sorted batches by their first ``keys`` columns."""
    key, rows = None, []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if key is None or row[:keys] != key:
                if key is not None:
                    yield key, rows
                key, rows = row[:keys], []
            rows.append(row[keys:])
    if key is not None:
        yield key, rows


def _batches(rows: Iterator[tuple], schema: pa.Schema, most: int = 2048, most_chars: int = 1 << 24) -> Iterator[pa.RecordBatch]:
    held, chars = [], 0
    for row in rows:
        held.append(row)
        chars += sum(len(v) for v in row if isinstance(v, str))
        if len(held) == most or chars >= most_chars:
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*held), schema.types)], schema=schema)
            held, chars = [], 0
    if held:
        yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*held), schema.types)], schema=schema)


def _facts(turns: list[int | None], roles: list[str], faults: list[str]) -> dict:
    """What can be added up over neighbouring blocks of rows in order of their turns."""
    known = [t for t in turns if t is not None]
    pairs = zip(roles, roles[1:])
    return {
        "low": known[0] if known else None,
        "high": known[-1] if known else None,
        "turns": len(set(known)),
        "blank": faults.count("blank"),
        "duplicate": faults.count("duplicate"),
        "truncated": faults.count("truncated"),
        "illegal": sum(a[:1] + b[:1] not in LEGAL for a, b in pairs),
        "first": roles[0][:1],
        "last": roles[-1][:1],
    }


def _added(a: dict, b: dict) -> dict:
    out = {k: a[k] + b[k] for k in ("turns", "blank", "duplicate", "truncated", "illegal")}
    out["turns"] -= a["high"] is not None and a["high"] == b["low"]
    out["illegal"] += a["last"] + b["first"] not in LEGAL
    out["low"] = b["low"] if a["low"] is None else a["low"]
    out["high"] = a["high"] if b["high"] is None else b["high"]
    return out | {"first": a["first"], "last": b["last"]}


def _counts(facts: dict) -> tuple[int, ...]:
    gaps = 0 if facts["low"] is None else facts["high"] - facts["low"] + 1 - facts["turns"]
    return gaps, facts["blank"], facts["duplicate"], facts["truncated"], facts["illegal"]


COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
NOTHING = hashlib.sha256(b"").hexdigest()


def _short(rows: DataFrame, conv_type: str) -> DataFrame:
    """Conversations that one agenda takes, one after the other from sorted partitions."""
    conv = to_arrow_type(rows.schema["conv_id"].dataType)
    schema = pa.schema(
        [("conv_id", conv), *((c, pa.int64()) for c in COUNTS), ("audit", pa.string()), ("repaired_sha256", pa.string())]
    )

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def results() -> Iterator[tuple]:
            for (conv_id,), found in _groups(batches, 1):
                left = [r[:3] for r in found if not r[3]]
                if not left:
                    yield (conv_id, *(0 for _ in COUNTS), "", NOTHING)
                    continue
                seen, faults = set(), []
                for _, role, text in left:
                    faults.append(fault(text, (role, text) in seen))
                    seen.add((role, text))
                turns, roles = [r[0] for r in left], [r[1] for r in left]
                cost, audit = repair(faults, roles)
                lines = "\n".join(repaired(((r[1], r[2]) for r in left), audit))
                digest = hashlib.sha256(lines.encode()).hexdigest()
                yield (conv_id, *_counts(_facts(turns, roles, faults)), cost, audit, digest)

        return _batches(results(), schema)

    kind = ", ".join(f"{c} long" for c in COUNTS)
    spread = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return spread.mapInArrow(solve, f"conv_id {conv_type}, {kind}, audit string, repaired_sha256 string")


def _long(rows: DataFrame, ids: DataFrame, conv_type: str, block: int) -> DataFrame:
    """Conversations of more rows: solved by blocks that are joined by spans."""
    conv = to_arrow_type(rows.schema["conv_id"].dataType)
    order = [F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]
    at = ordered_index(rows.filter("NOT gone").drop("gone"), order, ["conv_id"], "idx").drop("idx_n")
    at = at.withColumn("said", F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256))
    repeats = at.groupBy("conv_id", "said").agg(F.min("idx").alias("earliest"), F.count(F.lit(1)).alias("n_said"))
    repeats = cut(repeats.filter("n_said > 1").drop("n_said"))
    marked = grid_join(at, repeats, ["conv_id", "said"], F.col("idx"), F.lit(0), how="left", null_safe=True)
    marked = staged(
        marked.select(
            "conv_id",
            F.floor(F.col("idx") / block).cast("long").alias("block"),
            "idx", "turn", "role", "text",
            F.coalesce(F.col("idx") > F.col("earliest"), F.lit(False)).alias("again"),
        )
    )
    keys = ["conv_id", "block"]

    solved = pa.schema([("conv_id", conv), ("block", pa.int64()), ("spans", pa.string()), ("facts", pa.string())])

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def results() -> Iterator[tuple]:
            for key, found in _groups(batches, 2):
                faults = [fault(text, again) for _, _, _, text, again in found]
                roles = [r[2] for r in found]
                facts = _facts([r[1] for r in found], roles, faults)
                yield (*key, json.dumps(block_spans(faults, roles)), json.dumps(facts))

        return _batches(results(), solved)

    by_block = marked.repartition(*keys).sortWithinPartitions(*keys, "idx")
    spans = by_block.mapInArrow(solve, f"conv_id {conv_type}, block long, spans string, facts string")

    joined = pa.schema(
        [("conv_id", conv), ("block", pa.int64()), ("state", pa.int64()), *((c, pa.int64()) for c in COUNTS), ("audit", pa.string())]
    )

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def results() -> Iterator[tuple]:
            for (conv_id,), found in _groups(batches, 1):
                facts = None
                for _, _, text in found:
                    facts = json.loads(text) if facts is None else _added(facts, json.loads(text))
                (cost, audit), parts = join_spans([json.loads(s) for _, s, _ in found])
                yield (conv_id, -1, START, *_counts(facts), cost, audit)
                for (number, _, _), (state, part) in zip(found, parts):
                    yield (conv_id, number, state, *(0 for _ in COUNTS), part)

        return _batches(results(), joined)

    kind = ", ".join(f"{c} long" for c in COUNTS)
    by_conv = spans.repartition("conv_id").sortWithinPartitions(*keys)
    found = staged(by_conv.mapInArrow(join, f"conv_id {conv_type}, block long, state long, {kind}, audit string"))

    # a block's part of the audit comes first, then its rows
    part = found.filter("block >= 0").select(
        *keys, F.lit(-1).cast("long").alias("idx"), F.col("state").cast("string").alias("role"), F.col("audit").alias("text")
    )
    pieces = pa.schema([("conv_id", conv), ("block", pa.int64()), ("piece", pa.string())])

    def edit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def results() -> Iterator[tuple]:
            for key, held in _groups(batches, 2):
                (_, state, audit), *lines = held
                out = list(repaired(((role, text) for _, role, text in lines), audit, int(state)))
                if out:
                    yield (*key, "\n".join(out))

        return _batches(results(), pieces)

    whole = part.unionByName(marked.select(*keys, "idx", "role", "text"))
    whole = whole.repartition(*keys).sortWithinPartitions(*keys, "idx")
    texts = whole.mapInArrow(edit, f"conv_id {conv_type}, block long, piece string")

    digests = pa.schema([("conv_id", conv), ("repaired_sha256", pa.string())])

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def results() -> Iterator[tuple]:
            current, h = None, None
            for batch in batches:
                for conv_id, _, piece in zip(*(c.to_pylist() for c in batch.columns)):
                    if h is None or conv_id != current:
                        if h is not None:
                            yield current, h.hexdigest()
                        current, h = conv_id, hashlib.sha256()
                    else:
                        h.update(b"\n")
                    h.update(piece.encode())
            if h is not None:
                yield current, h.hexdigest()

        return _batches(results(), digests)

    sums = texts.repartition("conv_id").sortWithinPartitions(*keys).mapInArrow(
        digest, f"conv_id {conv_type}, repaired_sha256 string"
    )
    out = attach(ids, found.filter("block < 0").drop("block", "state"), ["conv_id"], "left")
    out = attach(out, sums, ["conv_id"], "left")
    return out.select(
        "conv_id",
        *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in COUNTS),
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.lit(NOTHING)).alias("repaired_sha256"),
    )


def repaired_conversations(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """One row per conversation of ``rows`` (conv_id, turn, role, text, gone)."""
    importable(rows.sparkSession)
    conv_type = rows.schema["conv_id"].dataType.simpleString()
    rows = rows.select("conv_id", "turn", "role", "text", "gone")
    sizes = rows.groupBy("conv_id").agg(F.count(F.lit(1)).alias("_n"))
    long = cut(sizes.filter(F.col("_n") > block).select("conv_id"))  # at most rows / block keys
    n_long = long.limit(BROADCAST_KEYS + 1).count()
    if n_long == 0:
        return _short(rows, conv_type)
    mark = long.withColumn("_long", F.lit(True))
    dealt = attach(rows, F.broadcast(mark) if n_long <= BROADCAST_KEYS else mark, ["conv_id"], "left")
    short = _short(dealt.filter("_long IS NULL").drop("_long"), conv_type)
    return short.unionByName(_long(dealt.filter("_long").drop("_long"), long, conv_type, block))


def conversation_repair(conversations: DataFrame, block: int = BLOCK) -> DataFrame:
    return repaired_conversations(damaged(conversations), block)
