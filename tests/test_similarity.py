"""The pruned joins and kernels against brute force on random data."""

import random

import pytest
from pyspark.sql import functions as F

from pairloom.operators import knn, skew
from pairloom.operators import simjoin as S


def random_sets(seed, n, hot=False):
    r = random.Random(seed)
    out = []
    for i in range(n):
        base = set(r.sample(range(40), r.randint(0, 12)))
        if hot and i % 3 == 0:
            base = set(range(12)) | {r.choice([50, 51, 52, 53])}
        out.append((i, "e1" if i % 2 else "e2", [str(x) for x in base]))
    return out


def tanimoto(a, b):
    a, b = set(a), set(b)
    return len(a & b), len(a | b)


@pytest.mark.parametrize("num,den", [(9, 10), (1, 2), (3, 10)])
def test_set_join_equals_brute_force(spark, num, den):
    rows = random_sets(num * den, 120, hot=True)
    df = spark.createDataFrame(rows, "id long, ep string, bits array<string>")
    left, right = df.filter("id % 4 < 2"), df.filter("id % 4 >= 2")
    ls, rs = (S.distinct_sets(x, ["ep"], "id", "bits") for x in (left, right))
    pairs = S.similar_sets(ls, rs, ["ep"], num, den)
    lm, rm = S.set_members(left, ls, ["ep"], "id", "bits"), S.set_members(right, rs, ["ep"], "id", "bits")
    got = {(r.l_entity, r.r_entity) for r in S.expand_members(pairs, lm, rm, ["ep"], "id").collect()}
    want = set()
    for i, e, a in rows:
        for j, f, b in rows:
            if e == f and i % 4 < 2 <= j % 4 and a and b:
                c, u = tanimoto(a, b)
                if c * den >= u * num:
                    want.add((i, j))
    assert got == want
    assert pairs.agg(F.sum("n_pairs")).first()[0] == len(want)


@pytest.mark.parametrize("strict", [True, False])
def test_self_join_counts_each_pair_once(spark, strict):
    rows = random_sets(5, 100, hot=True)
    df = spark.createDataFrame(rows, "id long, ep string, bits array<string>")
    sets = S.distinct_sets(df, ["ep"], "id", "bits")
    got = S.similar_sets_within(sets, ["ep"], 1, 2, strict).agg(F.sum("n_pairs")).first()[0]
    want = 0
    for i, e, a in rows:
        for j, f, b in rows:
            if i < j and e == f and a and b:
                c, u = tanimoto(a, b)
                want += c * 2 > u if strict else c * 2 >= u
    assert got == want


def test_only_pairs_at_the_threshold_leave_a_task(spark, monkeypatch):
    from pairloom.operators import setindex

    monkeypatch.setattr(setindex, "LEAST_SHARD", 100)
    monkeypatch.setattr(setindex, "CHUNK", 20)
    rows = random_sets(21, 160, hot=True)
    sets = S.distinct_sets(spark.createDataFrame(rows, "id long, ep string, bits array<string>"), ["ep"], "id", "bits")
    own = {(r.ep, r.first_id): set(r.bits) for r in sets.collect()}
    want = set()
    for (e, i), a in own.items():
        for (f, j), b in own.items():
            if e == f and i < j and len(a & b) * 10 >= len(a | b) * 4:
                want.add((i, j, len(a & b), len(a | b)))
    met = [tuple(r) for r in S._reached(sets, sets, ["ep"], 4, 10, within=True).select("q_id", "p_id", "n_common", "n_union").collect()]
    assert len(met) == len(want) and {(min(a, b), max(a, b), *c) for a, b, *c in met} == want
    cross = {tuple(r) for r in S.similar_sets(sets, sets, ["ep"], 4, 10).filter("l_id < r_id").select("l_id", "r_id", "n_common", "n_union").collect()}
    assert cross == want


def levenshtein(a, b):
    prev = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        cur = [i]
        for j, y in enumerate(b, 1):
            cur.append(min(prev[j] + 1, cur[-1] + 1, prev[j - 1] + (x != y)))
        prev = cur
    return prev[-1]


def test_edit_join_equals_brute_force(spark):
    r = random.Random(3)
    strings = ["", "abc", "abcdefgh", "abcdefghi", "a" * 10, "a" * 9 + "b", "é" * 20, "é" * 19 + "e", "x" * 20, "x" * 18]
    for n in (9, 10, 11, 20, 40, 134, 135, 150, 200):
        for _ in range(6):
            s = "".join(r.choice("abcdé") for _ in range(n))
            strings.append(s)
            t = list(s)
            for _ in range(r.randint(0, n // 8)):
                k = r.randrange(len(t))
                op = r.random()
                if op < 0.4:
                    t[k] = r.choice("abcdé")
                elif op < 0.7:
                    t.insert(k, r.choice("abcdé"))
                elif len(t) > 1:
                    t.pop(k)
            strings.append("".join(t))
    rows = [(i, "e", s) for i, s in enumerate(strings)]
    df = spark.createDataFrame(rows, "id long, ep string, s string")
    left, right = df.filter("id % 2 = 0"), df.filter("id % 2 = 1")
    pairs = S.similar_strings(
        S.distinct_strings(left, ["ep"], "id", "s"), S.distinct_strings(right, ["ep"], "id", "s"), ["ep"]
    )
    text = dict((i, s) for i, _, s in rows)
    got = {(text[p.l_id], text[p.r_id], p.distance) for p in pairs.collect()}
    want = set()
    for i, _, a in rows:
        for j, _, b in rows:
            if i % 2 == 0 and j % 2 == 1 and a and b:
                d = levenshtein(a, b)
                if 10 * d <= max(len(a), len(b)):
                    want.add((a, b, d))
    assert got == want


def test_edit_join_query_lists_every_row_of_equal_strings(spark, tmp_path):
    import duckdb

    from pairloom.plans.catalog import ORACLES, QUERIES

    urls = ["https://a.example.com/en/12345"] * 5 + ["https://a.example.com/en/12346"] * 4 + ["http://b.example.org/x"]
    path = str(tmp_path / "pages.parquet")
    spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("html", F.lit("")).write.parquet(path)
    got = sorted(map(tuple, QUERIES["J3_edit_join"](spark, str(tmp_path)).collect()))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{path}/*.parquet'")
    assert got == sorted(con.execute(ORACLES["J3_edit_join"]).fetchall()) and len(got) == 20


def test_few_grams_pass_the_filter(spark):
    r = random.Random(8)
    text = lambda: "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randrange(30, 120)))
    left = [(i, "e", text()) for i in range(60)]
    right = [(100 + i, "e", text()) for i in range(600)] + [(900 + i, "e", s[:-1] + "x") for i, _, s in left]
    make = lambda rows: S.distinct_strings(spark.createDataFrame(rows, "id long, ep string, s string"), ["ep"], "id", "s")
    pieces, strings = S._placed_pieces(make(left), ["ep"]), make(right)
    every, passed = S._placed_grams(strings, ["ep"]), S.met_grams(pieces, strings, ["ep"])
    assert passed.count() * 10 < every.count()
    # nothing that is a piece at its place is lost
    keys = S._banded(pieces).select("ep", "cls", "key").distinct()
    wanted = every.join(keys, ["ep", "cls", "key"], "left_semi").select(passed.columns)
    assert wanted.exceptAll(passed).count() == 0


def test_grid_join_splits_a_hot_key(spark):
    a = spark.range(60).select((F.col("id") % 3 * (F.col("id") % 2)).alias("k"), F.col("id").alias("x"))
    b = spark.range(50).select((F.col("id") % 2).alias("k"), F.col("id").alias("y"))
    got = skew.grid_join(a, b, ["k"], F.col("x"), F.col("y"), cell_rows=4)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, a.join(b, "k").collect()))


@pytest.mark.parametrize("distinct_anchor", [False, True])
def test_nearest_equals_brute_force_over_many_tiles(spark, distinct_anchor):
    rows = random_sets(11, 90, hot=True)
    df = spark.createDataFrame(rows, "id long, ep string, bits array<string>").withColumn("a", F.concat(F.lit("a"), F.col("id") % 25))
    q = df.filter("id % 3 = 0").select("ep", F.col("id").alias("q_id"), F.col("a").alias("q_anchor"), F.col("bits").alias("q_bits"))
    p = df.select("ep", F.col("id").alias("p_id"), F.col("a").alias("p_anchor"), F.col("bits").alias("p_bits"))
    got = {(r.q_id, r["rank"]): r.p_id for r in knn.nearest(q, p, 4, ["ep"], distinct_anchor=distinct_anchor, shard_rows=7).collect()}
    for i, e, a in rows:
        if i % 3:
            continue
        ranked = []
        for j, f, b in rows:
            if e == f and i % 25 != j % 25:
                c, u = tanimoto(a, b)
                ranked.append((-(c / u if u else 0.0), j))
        kept, seen = [], set()
        for _, j in sorted(ranked):
            if distinct_anchor and j % 25 in seen:
                continue
            seen.add(j % 25)
            kept.append(j)
        assert [got.get((i, k + 1)) for k in range(4)] == kept[:4]


def test_similarity_stats_over_tiles(spark):
    import numpy as np

    rows = [r for r in random_sets(2, 80, hot=True) if r[2]]
    df = spark.createDataFrame(rows, "id long, ep string, bits array<string>")
    ls = S.distinct_sets(df.filter("id % 4 < 2"), ["ep"], "id", "bits")
    rs = S.distinct_sets(df.filter("id % 4 >= 2"), ["ep"], "id", "bits")
    for r in knn.similarity_stats(ls, rs, ["ep"]).collect():
        sims = []
        for i, e, a in rows:
            for j, f, b in rows:
                if e == f == r.ep and i % 4 < 2 <= j % 4:
                    c, u = tanimoto(a, b)
                    sims.append(c / u)
        assert r.n_pairs == len(sims)
        assert r.mean_sim == pytest.approx(np.mean(sims))
        assert r.median_sim == pytest.approx(np.median(sims))
        assert r.std_sim == pytest.approx(np.std(sims))
        assert (r.max_sim, r.min_sim) == (pytest.approx(max(sims)), pytest.approx(min(sims)))


def test_few_long_texts_of_one_vocabulary_are_candidates():
    import pyarrow as pa

    r = random.Random(4)
    vocabulary = ["".join(r.choice("abcdeinorst") for _ in range(r.randrange(2, 9))) for _ in range(300)]
    texts = [" ".join(r.choice(vocabulary) for _ in range(r.randrange(100, 130))) for _ in range(120)]
    near = []
    for t in texts:
        n, s = len(t) // 12, list(t)  # fewer edits than the limit, spread over the text
        for i in r.sample(range(len(s)), n):
            s[i] = r.choice(["", "x", s[i] + "y"])
        near.append("".join(s))
    index = S.PieceIndex(pa.array(texts))
    found = [index.near(t).tolist() for t in near]
    assert all(i in rows for i, rows in enumerate(found))
    assert sum(map(len, found)) < 2 * len(texts)


def test_short_strings_are_measured_where_they_are_searched(monkeypatch):
    """Exact distances from the prefix tree, against all pairs; only pairs of long strings stay candidates."""
    import numpy as np
    import pyarrow as pa

    def distance(a, b):
        p = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            c = [i]
            for j, y in enumerate(b, 1):
                c.append(min(p[j - 1] + (x != y), p[j] + 1, c[-1] + 1))
            p = c
        return p[-1]

    rng = random.Random(3)

    def changed(t):
        t = list(t)
        for _ in range(rng.randint(0, len(t) // 8)):
            at, new = rng.randrange(len(t) + 1), rng.choice("abé\U0001f600")
            t[at : at + rng.randint(0, 1)] = rng.choice(([new], []))
        return "".join(t)

    sizes = (1, 5, 8, 9, 10, 11, 19, 20, 21, 44, 100, 134, 140, 150)
    base = ["".join(rng.choice("abé\U0001f600\0") for _ in range(n)) for n in sizes for _ in range(3)]
    left, right = (sorted({changed(t) for t in base for _ in range(3)} - {""}) for _ in range(2))
    want = {(r, x): d for r in right for x in left if 10 * (d := distance(r, x)) <= max(len(r), len(x))}
    for held in (S.HELD_STATES, 5):
        monkeypatch.setattr(S, "HELD_STATES", held)
        text, row, found = (np.concatenate(x) for x in zip(*S.StringIndex(pa.array(left)).near(right)))
        got = {(right[t], left[r]): d for t, r, d in zip(text.tolist(), row.tolist(), found.tolist())}
        assert len(got) == len(text) and want.keys() <= got.keys()
        assert {p: d for p, d in got.items() if len(p[1]) < S.SHORT} == {p: d for p, d in want.items() if len(p[1]) < S.SHORT}
        assert all(d == -1 for p, d in got.items() if len(p[1]) >= S.SHORT)


def test_what_a_task_holds_does_not_go_by_what_it_finds(monkeypatch):
    """All rows of a batch reach all rows of a shard: the pairs leave the task in parts, for sets and for strings."""
    import pyarrow as pa

    monkeypatch.setattr(S, "HELD_FOUND", 100)
    monkeypatch.setattr(S, "HELD_STATES", 100)
    n = 60
    ids, ones, none = pa.array(range(n)), pa.array([1] * n), pa.nulls(n)
    for build, answer, values in (
        (S.SetIndex, S._met(1, 2, False), pa.array([["a", "b", f"t{i}"] for i in range(n)])),
        (S.StringIndex, S._likely, pa.array([f"a string of one host {i:02d}" for i in range(n)])),
    ):
        pool = pa.record_batch([none, none, values, ids, ones], list("abcde"))
        asked = pa.record_batch([none, none, values, none, none, none, none, pa.array(["x"] * n), ids, ones], list("abcdefghij"))
        parts = list(answer(build(values), pool, asked))
        assert sum(len(p) for p in parts) == n * n
        assert len(parts) > 5 and max(len(p) for p in parts) < n * n / 2


def test_edit_distance_of_code_points():
    """Within every limit against the whole table; far texts give -1."""

    def table(a, b):
        p = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            c = [i]
            for j, y in enumerate(b, 1):
                c.append(min(p[j - 1] + (x != y), p[j] + 1, c[-1] + 1))
            p = c
        return p[-1]

    rng = random.Random(7)
    for n in (0, 1, 2, 7, 25, 25, 25, 700):
        for letters in ("ab", "abcd", "aé—\U0001f600", "ab\0"):
            a = "".join(rng.choice(letters) for _ in range(n))
            b = list(a)
            for _ in range(rng.randint(0, 6)):
                at = rng.randrange(len(b) + 1)
                b[at : at + rng.randint(0, 2)] = rng.choice(([rng.choice(letters)], []))
            d = table(a, b)
            for limit in (0, 1, 3, 8, 30):
                got = S.edit_distance(*(S.PieceIndex.points(t) for t in (a, "".join(b))), limit)
                assert got == (d if d <= limit else -1)


def test_distances_of_long_strings_go_by_the_distance():
    """A banded table of these two would have 240 million cells."""
    a = S.PieceIndex.points("abcdefgh" * 3_000)
    b = S.PieceIndex.points("abcdefgh" * 1_500 + "xyz" + "abcdefgh" * 1_499)
    assert S.edit_distance(a, b, 2_400) == 8


def test_sets_are_written_compressed(spark):
    """The sets that every set join reads are a compressed table, not a checkpoint of arrays."""
    rows = spark.range(40).select("id", F.array(*[(F.col("id") % k).cast("string") for k in (3, 5, 7)]).alias("bits"))
    sets = S.distinct_sets(rows, [], "id", "bits")
    assert all(f.endswith(".zstd.parquet") for f in sets.inputFiles()) and sets.inputFiles()
