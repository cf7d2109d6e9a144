"""Nearest neighbours and histograms on sharded set indexes: against all pairs."""

import collections
import random

import pytest
from pyspark.sql import functions as F

from pairloom.operators import knn, setindex

Q = "lang string, q_id long, q_anchor string, q_bits array<string>"
P = "lang string, p_id long, p_anchor string, p_bits array<string>"


def sim(a, b):
    a, b = set(a), set(b)
    return len(a & b) / max(len(a | b), 1)


def brute(queries, pool, k, max_sim=None, distinct=False):
    out = []
    for lang, q, anchor, bits in queries:
        if bits is None:
            continue
        found = []
        for other, p, p_anchor, p_bits in pool:
            if other != lang or p_bits is None or (anchor is not None and p_anchor == anchor):
                continue
            s = sim(bits, p_bits)
            if max_sim is None or s <= max_sim:
                found.append((-s, p, p_anchor))
        found.sort(key=lambda r: r[:2])
        if distinct:
            seen, once = set(), []
            for r in found:
                if r[2] and r[2] not in seen:
                    seen.add(r[2])
                    once.append(r)
            found = once
        out += [(lang, q, n, p, round(-s, 9)) for n, (s, p, _) in enumerate(found[:k], 1)]
    return sorted(out, key=str)


def tables(seed, n=260):
    rng = random.Random(seed)
    words = [f"t{i}" for i in range(400)]
    centres = [rng.sample(words, rng.choice([5, 12, 30, 60])) for _ in range(12)]

    def bits():
        base = [w for w in rng.choice(centres) if rng.random() < 0.85]
        return list(dict.fromkeys(base + rng.sample(words, rng.randrange(4)) + ["common"]))

    def rows(n, first):
        out = []
        for i in range(n):
            lang = rng.choice(["a", "a", "a", "b", None])
            b = rng.choice([bits(), bits(), bits(), bits(), [], None, [f"only{i}"]])
            out.append((lang, first + i, rng.choice(["x", "y", "z", "", None, f"u{i}", f"u{i}"]), b))
        return out

    queries, pool = rows(n // 3, 0), rows(n, 1000)
    pool += [("a", 5000 + i, f"c{i}", ["hot", "set"]) for i in range(120)]  # one size holds a third of the pool
    return queries + [("a", 900, "q", ["hot", "set"]), ("none", 901, "q", ["hot"])], pool


@pytest.mark.parametrize("shard, one_round", [(None, 64), (16, 64), (16, 1)])
@pytest.mark.parametrize("max_sim, distinct", [(None, False), (None, True), (0.5, True)])
def test_nearest(spark, monkeypatch, shard, one_round, max_sim, distinct):
    if shard:
        monkeypatch.setattr(setindex, "CHUNK", 20)
    queries, pool = tables(1)
    q, p = spark.createDataFrame(queries, Q).repartition(3), spark.createDataFrame(pool, P).repartition(3)
    got = knn.nearest(q, p, 4, ["lang"], max_sim=max_sim, distinct_anchor=distinct, shard_rows=shard, one_round=one_round)
    got = sorted(((r.lang, r.q_id, r["rank"], r.p_id, round(r.sim, 9)) for r in got.collect()), key=str)
    assert got == brute(queries, pool, 4, max_sim, distinct)


def test_without_block_and_empty(spark):
    queries, pool = tables(2, 60)
    q, p = spark.createDataFrame(queries, Q).drop("lang"), spark.createDataFrame(pool, P).drop("lang")
    got = sorted((r.q_id, r["rank"], r.p_id, round(r.sim, 9)) for r in knn.nearest(q, p, 3).collect())
    want = brute([("a", *r[1:]) for r in queries], [("a", *r[1:]) for r in pool], 3)
    assert got == sorted(r[1:] for r in want)
    assert knn.nearest(q.filter("1 = 0"), p, 3).count() == 0 and knn.nearest(q, p.filter("1 = 0"), 3).count() == 0


def test_few_pairs_are_compared(spark):
    """Groups of similar sets that share common words: a search counts its own group, not the pool."""
    rng = random.Random(3)

    def member(g):
        size = 10 + 5 * (g % 8)
        own = [f"g{g}w{i}" for i in range(size)]
        return [w for w in own if rng.random() < 0.97] + ["the", "of"]

    queries = [("a", g, f"q{g}", member(g)) for g in range(200)]
    pool = [("a", 1000 + g * 20 + i, f"p{g}.{i}", member(g)) for g in range(200) for i in range(20)]
    q, p = spark.createDataFrame(queries, Q), spark.createDataFrame(pool, P)
    for shard, one_round in ((4096, 64), (128, 4)):
        work = knn.search_costs(q, p, 5, ["lang"], shard, one_round).agg(F.sum("compared")).first()[0]
        assert 200 * 5 <= work < 0.02 * len(queries) * len(pool)
        got = knn.nearest(q, p, 5, ["lang"], shard_rows=shard, one_round=one_round)
        assert sorted((r.lang, r.q_id, r["rank"], r.p_id, round(r.sim, 9)) for r in got.collect()) == sorted(brute(queries, pool, 5))


def test_histogram(spark, monkeypatch):
    monkeypatch.setattr(knn, "HELD_PAIRS", 50)
    _, pool = tables(4, 120)
    rows = [(lang, i, 1 + i % 3, sorted(b)) for lang, i, _, b in pool if b]
    schema = "lang string, first_id long, n_members long, bits array<string>"
    left, right = rows[::2], rows[1::2]
    want = collections.defaultdict(lambda: [0, None])
    for a in left:
        for b in right:
            common = len(set(a[3]) & set(b[3]))
            if a[0] == b[0] and common:
                key = (a[0], common, len(set(a[3]) | set(b[3])))
                want[key][0] += a[2] * b[2]
                want[key][1] = min(want[key][1] or (a[1], b[1]), (a[1], b[1]))
    for shard in (None, 9):
        got = knn.similarity_histogram(spark.createDataFrame(left, schema), spark.createDataFrame(right, schema), ["lang"], shard)
        assert {(r.lang, r.n_common, r.n_union): [r.n_pairs, tuple(r.pair)] for r in got.collect()} == dict(want)


def test_shards_are_copied_only_to_fill_tasks():
    assert setindex.copies(10**9, 1, 12) == 24
    assert setindex.copies(10**9, 24, 12) == setindex.copies(10**9, 5000, 12) == 1
    assert setindex.copies(100, 1, 12) == 1


def test_shards_hold_about_equally_many_tokens(spark, monkeypatch):
    monkeypatch.setattr(setindex, "LEAST_SHARD", 1000)
    rows = [("a", i, [f"w{i}.{j}" for j in range(200 if i % 10 == 0 else 5)]) for i in range(400)]
    pool = spark.createDataFrame(rows, "lang string, p_id long, bits array<string>")
    shards = setindex.Shards(pool, ["lang"], ["p_id"])
    tokens = [r[0] for r in shards.rows.groupBy("b", "shard").agg(F.sum(F.col("n") + setindex.ROW_WEIGHT)).select("sum((n + %d))" % setindex.ROW_WEIGHT).collect()]
    assert len(tokens) > 4 and max(tokens) < 3 * sum(tokens) / len(tokens)


def test_counting_many_queries_equals_counting_one(monkeypatch):
    import numpy as np
    import pyarrow as pa

    monkeypatch.setattr(setindex, "DENSE_CELLS", 60 * 20)  # few lists fit the matrix
    rng = random.Random(9)
    sets = [sorted({f"t{int(rng.random() ** 3 * 200)}" for _ in range(rng.randrange(1, 60))}) for _ in range(60)]
    index = setindex.SetIndex(pa.array(sets))
    codes = [c for _, c in index.lookup(pa.array(sets))]
    for one, each in zip(codes, index.counted_each(codes)):
        assert np.array_equal(index.counted(one), each)
    assert 0 < len(index.dense) <= 20


def test_sets_move_as_strings_without_merging_tokens(spark):
    sets = [["a\nb", "c"], ["a\\nb", "c"], ["a", "b", "c"], [], [""], ["\n"], ["\\"], ["", "\n", "é"]]
    d = spark.createDataFrame(list(enumerate(sets)), "i long, bits array<string>").select("i", setindex.joined("bits").alias("bits"))
    rows = d.orderBy("i").toArrow().column("bits").combine_chunks()
    index = setindex.SetIndex(setindex.parted(rows))
    assert index.sizes.tolist() == [len(s) for s in sets]
    assert len(index.tokens) == len({t for s in sets for t in s})
    part = setindex.parted(rows.slice(1, 3))
    assert [len(s) for s in part.to_pylist()] == [2, 3, 0] and part.to_pylist()[1] == ["a", "b", "c"]
    words = [[f"word{i}.{j}" for j in range(40)] for i in range(300)]
    pool = spark.createDataFrame(list(enumerate(words)), "p_id long, bits array<string>")
    shards = setindex.Shards(pool, [], ["p_id"])
    assert shards.joined and dict(shards.rows.dtypes)["bits"] == "string"


def test_rare_tokens_are_not_searched_where_they_answer_nothing():
    """Sets that are all far from each other: after a few tries a query counts at once, and only rows that can win are compared."""
    import numpy as np
    import pyarrow as pa

    rng = random.Random(11)
    sets = [sorted({f"t{int(rng.random() ** 2 * 300)}" for _ in range(30)}) for _ in range(900)]
    pool, asked = pa.array(sets[:700]), pa.array(sets[700:])
    index = setindex.SetIndex(pool)
    searcher = knn._Searcher(index, pa.array([f"a{i % 90}" for i in range(700)]), 5, None, False)
    calls, near = [], index.near
    index.near = lambda *a: calls.append(1) or near(*a)
    queries = list(index.lookup(asked))
    assert all(searcher.near(size, codes, i % 90, -1.0) is None for i, (size, codes) in enumerate(queries))
    assert len(calls) == knn.FEW_TRIES
    looked = 0
    for i, ((size, _), every) in enumerate(zip(queries, index.counted_each([c for _, c in queries]))):
        assert every.dtype == np.uint8
        at, all_rows = searcher.leading(size, every, i % 90, -1.0), np.flatnonzero(every)
        looked += len(at) / len(all_rows) / len(queries)
        for got, want in zip(*(searcher.best(size, rows, every[rows], i % 90, -1.0, True) for rows in (at, all_rows))):
            assert np.array_equal(got, want)
    assert looked < 0.3


def test_counts_of_large_sets_do_not_overflow():
    import numpy as np
    import pyarrow as pa

    sets = [[f"t{i}" for i in range(n)] for n in (3, 255, 256, 700)]
    index = setindex.SetIndex(pa.array(sets))
    codes = [c for _, c in index.lookup(pa.array(sets))]
    for one, each in zip(codes, index.counted_each(codes)):
        assert np.array_equal(index.counted(one), each)
    assert max(index.counted(codes[3])) == 700


def test_histogram_hands_on_each_cell_once(monkeypatch):
    """However many batches of queries pass a shard, a task gives one row a cell, in pieces of bounded size."""
    import pyarrow as pa

    monkeypatch.setattr(knn, "HELD_PAIRS", 50)
    monkeypatch.setattr(setindex, "SENT_ROWS", 16)
    rng = random.Random(4)
    sets = lambda n: [sorted(rng.sample([f"t{i}" for i in range(30)], rng.randint(1, 12))) for _ in range(n)]
    left, right = sets(90), sets(40)
    want = collections.defaultdict(lambda: [0, None])
    for i, a in enumerate(left):
        for j, b in enumerate(right):
            if n := len(set(a) & set(b)):
                cell = want[n, len(set(a) | set(b))]
                cell[0] += (i + 1) * (j + 1)
                cell[1] = min(cell[1] or (i, j), (i, j))
    named = pa.schema([("b", pa.string()), ("n_common", pa.int64()), ("n_union", pa.int64()), ("n_pairs", pa.int64()), ("l_id", pa.int64()), ("r_id", pa.int64())])
    names = ["cell", "side", "bits", "r_id", "r_w", "row", "least", "b", "l_id", "l_w"]
    kinds = [pa.int64(), pa.int32(), pa.list_(pa.string()), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.string(), pa.int64(), pa.int64()]

    def batch(rows):
        return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)

    pool = [(0, 0, b, j, j + 1, None, None, None, None, None) for j, b in enumerate(right)]
    asked = [(0, 1, a, None, None, i, 0.0, "x", i, i + 1) for i, a in enumerate(left)]
    for cells in (knn.TABLE_CELLS, 1):
        monkeypatch.setattr(knn, "TABLE_CELLS", cells)
        run = setindex._serve(knn.PairCells, knn._histogram, named, False, knn.PairCells.drained)
        sent = list(run(iter([batch(pool), *(batch(asked[i : i + 30]) for i in (60, 0, 30))])))
        assert max(len(x) for x in sent) <= 16
        got = [tuple(r.values()) for x in sent for r in x.to_pylist()]
        assert sorted(got) == sorted(("x", c, u, w, *pair) for (c, u), (w, pair) in want.items())
