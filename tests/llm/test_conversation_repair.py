"""Conversation repair: against an exhaustive recursion over all edits, with whole and cut conversations."""

import functools
import hashlib
import random
import re
import zlib

import pytest

from pairloom.llm import op12_conversation_repair as op

WORD = re.compile(r"[^\x20\x09-\x0D]")
GRAMMAR = re.compile(r"(s?(ua)+)?")


def cheapest(rows):
    """rows: (kind, role, text). Every edit of every row, and up to three insertions in a gap, as suffixes."""

    @functools.cache
    def best(i, last, inserted):
        # last: the last initial said, '' if none; a suffix must complete (s?(ua)+)?
        out = []
        if i == len(rows):
            if last in ("", "a"):
                out.append((0, "", ()))
        else:
            kind, role, text = rows[i]
            c, a, lines = best(i + 1, last, 0)
            out.append((c + 3, "D" + a, lines))
            if kind not in ("blank", "duplicate"):
                extra = kind == "truncated"
                for new, cost, letter in ((role, 0, "K"), ("user", 2, "R"), ("assistant", 2, "R")):
                    if follows(last, new[:1]):
                        c, a, lines = best(i + 1, new[:1], 0)
                        out.append((c + cost + extra, letter + a, (f"{new}:{text}", *lines)))
        if inserted < 3:
            for new in ("user", "assistant"):
                if follows(last, new[0]):
                    c, a, lines = best(i, new[0], inserted + 1)
                    out.append((c + 2, "I" + a, (f"{new}:", *lines)))
        return min(out) if out else (10**9, "", ())

    def follows(last, new):
        return len(new) == 1 and last + new in ("s", "u", "su", "ua", "au")

    return best(0, "", 0)


def expected(conv, rows):
    """rows of a conversation as (turn, role, text) before damage."""
    after = []
    sp = lambda v: " " if v is None else str(v)
    for turn, role, text in rows:
        code = zlib.crc32(f"{sp(conv)}:{sp(turn)}".encode()) % 20
        role, text = sp(role), sp(text)
        if code == 0:
            continue
        if code == 1:
            text = ""
        if code == 2:
            text = re.sub("[.!?]", "", text)
        if code == 4:
            role = "user"
        after += [(turn, role, text)] * (2 if code == 3 else 1)
    after.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
    kinds, seen = [], set()
    for _, role, text in after:
        found = WORD.findall(text)
        kinds.append(
            "blank" if not found else "duplicate" if (role, text) in seen else "" if found[-1] in ".!?" else "truncated"
        )
        seen.add((role, text))
    turns = [t for t, _, _ in after if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(after, after[1:]))
    cost, audit, lines = cheapest(tuple((k, r, t) for k, (_, r, t) in zip(kinds, after)))
    sums = (gaps, kinds.count("blank"), kinds.count("duplicate"), kinds.count("truncated"), illegal)
    return (conv, *sums, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())


def check(df, block):
    by = {}
    for r in df.select("conv_id", "turn", "role", "text").collect():
        by.setdefault(r.conv_id, []).append((r.turn, r.role, r.text))
    want = sorted((expected(c, rows) for c, rows in by.items()), key=str)
    got = sorted(map(tuple, op.conversation_repair(df, block).collect()), key=str)
    assert got == want
    return got


def rows_of(seed, convs, most):
    rng = random.Random(seed)
    texts = ["Hello there.", "what now?", "cut off in the", "", " \t\n", "Hello there.", "é 日本!", "No…", "a" * 3000 + "."]
    roles = ["user", "assistant", "system", "user", "assistant", "tool", "", "S", None, "u"]
    rows = []
    for conv in convs:
        for turn in range(rng.randrange(1, most)):
            t = None if rng.random() < 0.05 else turn * rng.choice([1, 1, 1, 2])
            rows.append((conv, t, rng.choice(roles), rng.choice([*texts, None, f"line {turn}."])))
            if rng.random() < 0.1:
                rows.append(rows[-1])
    return rows


SCHEMA = "conv_id long, turn long, role string, text string"


@pytest.mark.parametrize("block", [2, 5, 512])
def test_random_conversations(spark, block):
    df = spark.createDataFrame(rows_of(block, [None, *range(60)], 14), SCHEMA).selectExpr("*", "'x' AS gone", "1 AS block", "2 AS idx")
    got = check(df.repartition(3), block)
    assert len(got) == 61


def test_whole_table(spark):
    check(spark.read.parquet("/root/testdata/sf0.001/conversations.parquet"), 512)


def test_one_conversation_with_most_rows(spark):
    rows = rows_of(1, [5] * 40, 20) + rows_of(2, range(10, 30), 6)
    check(spark.createDataFrame(rows, SCHEMA).repartition(4), 16)


def test_empty_and_dropped(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert op.conversation_repair(df).count() == 0
    conv = next(c for c in range(1000) if all(zlib.crc32(f"{c}:{t}".encode()) % 20 == 0 for t in (0,)))
    for block in (1, 512):
        df = spark.createDataFrame([(conv, 0, "user", "hi.")] * 3, SCHEMA)
        assert check(df, block) == [(conv, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
    clean = spark.createDataFrame([(1, 0, "user", "hi."), (1, 1, "assistant", "yes.")], SCHEMA)
    r = op.repaired_conversations(op.as_is(clean)).first()
    assert (r.cost, r.audit, r.gaps, r.illegal) == (0, "KK", 0, 0)


def test_agenda_pops_each_item_once_in_order_of_weight():
    popped = []
    faults, roles = ["", "truncated", "blank", ""], ["user", "user", "user", "assistant"]
    steps = op.edits(faults, roles)

    def deduce(item, chart):
        popped.append(chart[item][:2])
        return steps(item, chart)

    op.lightest([(0, "", (0, op.START), None)], deduce)
    assert popped == sorted(popped) and len(popped) <= 4 * 5
    assert GRAMMAR.fullmatch("".join(x[0] for x in op.repaired(zip(roles, "abcd"), op.repair(faults, roles)[1])))
