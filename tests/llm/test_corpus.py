"""Mixing, fingerprints, language model, toxicity, joins and the pipeline: against brute force."""

import collections
import hashlib
import math
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from pairloom.llm import op6_fingerprints as fp
from pairloom.llm.graph import components
from pairloom.llm.lattice import Lattice, vocabulary
from pairloom.llm.op4_lm_scores import lm_scores
from pairloom.llm.op5_mixing import mix_plan, mixed
from pairloom.llm.op7_embedding_dedup import Bounds, build, near_duplicates, squared
from pairloom.llm.op8_toxicity import calibrate, toxicity, train
from pairloom.llm.op10_ngram_join import deduplicated, jaccard_join, shortened
from pairloom.llm.tokens import tokenizer_path

WORD = re.compile(r"[^\x20\x09-\x0D]+")


# mixing


def targets(sizes):
    """The rule as it is told: shares by weight, what is above the limit reshared until none is above."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}
    want, out, open_ = 1.5 * sum(sizes.values()), {}, set(names)
    while open_:
        level = (want - sum(out.values())) / sum(w[s] for s in open_)
        above = {s for s in open_ if level * w[s] >= 2 * sizes[s]}
        if not above:
            return out | {s: level * w[s] for s in open_}
        out |= {s: 2.0 * sizes[s] for s in above}
        open_ -= above
    return out


def test_mixing(odd, empty, small):
    assert mix_plan(empty).count() == 0 and mixed(empty).count() == 0
    for docs in (odd, small):
        rows = docs.select("doc_id", "text", "source").collect()
        sizes = collections.Counter()
        for d in rows:
            sizes[d.source] += len(WORD.findall(d.text or ""))
        want = targets(sizes)
        got = mix_plan(docs).collect()
        assert len(got) == len(rows)
        by = {d.doc_id: d for d in rows}
        for r in got:
            d = by[r.doc_id]
            if r.doc_id is not None:
                assert r.size == len(WORD.findall(d.text or "")) and r.source_size == sizes[d.source]
                assert r.target == pytest.approx(want[d.source])
            assert r.taken in (r.size * math.floor(r.target / max(r.source_size, 1)), r.size * math.ceil(r.target / max(r.source_size, 1)))
            assert r.taken <= 2 * r.size
        assert sorted(map(str, got)) == sorted(map(str, mix_plan(docs).collect()))
        assert mixed(docs).columns == docs.columns
        assert mixed(docs).count() == sum(r.copies for r in got)


def test_many_equal_sources_come_near_their_targets(spark):
    docs = spark.range(6000).selectExpr("id AS doc_id", "'one two three' AS text", "CAST(id % 3 AS string) AS source")
    got = mix_plan(docs).groupBy((F.col("doc_id") % 3).alias("s")).agg(F.sum("taken").alias("t"), F.max("target").alias("g")).collect()
    assert all(abs(r.t - r.g) < 0.05 * r.g for r in got)


# fingerprints


def test_fingerprints(odd, empty, small):
    assert fp.fingerprints(empty).count() == 0
    for docs in (odd, small):
        rows = [(d.doc_id, d.text or "") for d in docs.select("doc_id", "text").collect()]
        rows.sort(key=lambda d: (d[0] is None, -(d[0] or 0), d[1].encode()))
        want = collections.Counter()
        for k, (doc, text) in enumerate(rows):
            after = rows[(k + 1) % len(rows)][1]
            h = len(text) // 2
            edited = text[: len(text) - h] + after[:h]
            want[(doc, len(text), hashlib.sha256(edited.encode()).hexdigest())] += 1
        got = fp.fingerprints(docs, buckets=7).collect()
        assert collections.Counter((r.doc_id, r.n_chars, r.edited_sha256) for r in got) == want
        texts = dict(rows)
        by = collections.defaultdict(set)
        for r in got:
            if r.doc_id is not None:
                by[texts[r.doc_id]].add(r.fingerprint)
            assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
            if r.fingerprint == r.edited_fingerprint:
                assert r.near_edited == 1
        assert all(len(v) == 1 for v in by.values())


def test_order_insertion_and_deletion(spark):
    a, b = "first one.\nsecond one.\nthird", "third\nfirst one.\nsecond one."
    cells = lambda *t: fp.fingerprint_cells(spark.createDataFrame([(1, x) for x in t], "doc_id long, text string"))
    rows = lambda d: sorted(map(tuple, d.collect()))
    assert rows(cells(a)) == rows(cells(b))
    assert rows(fp.combined(cells(a), cells("fourth"))) == rows(cells(a + "\nfourth"))
    assert rows(fp.combined(cells(a + "\nfourth"), cells("fourth"), -1)) == rows(cells(a))


def test_likeness_follows_common_paragraphs(spark):
    lines = [f"line number {k} of the text" for k in range(900)]
    text = "\n".join(lines)
    docs = [(2, text), (1, "\n".join(lines[:700] + [f"other {k}" for k in range(200)]))]
    r = fp.fingerprints(spark.createDataFrame(docs, "doc_id long, text string"), buckets=4).filter("doc_id = 2").first()
    assert abs(r.near_next - 700 / 1100) < 0.25
    assert fp.fingerprints(spark.createDataFrame([(1, text), (2, text)], "doc_id long, text string")).filter("near_next = 1").count() == 2


def test_bucket_search(spark):
    bounds = [3, 5, 5, 8, 20, 21, 22]
    got = spark.range(25).select("id", fp.bucket_of(F.col("id"), bounds).alias("b")).collect()
    assert all(r.b == sum(x <= r.id for x in bounds) for r in got)


# language model


def test_lattice_sums_all_spellings():
    lattice = Lattice(["▁a", "b", "ab", "▁", "a", "▁ab"], list(range(6, 262)))
    logp = np.log(np.linspace(0.5, 1.5, 262) / 262)
    p = {x: math.exp(logp[i]) for i, x in enumerate(lattice.pieces)}

    def spell(text):
        if not text:
            return 1.0
        total = math.exp(sum(logp[6 + b] for b in text[0].encode())) * spell(text[1:])
        return total + sum(p[x] * spell(text[len(x) :]) for x in p if text.startswith(x))

    words = ["ab", "aab", "b", "é", "abab"]
    got = lattice.log_marginals(words, logp)
    assert np.exp(got) == pytest.approx([spell("▁" + w) for w in words])
    uses = lattice.expected(words, np.ones(5), logp)
    lengths = sum(uses[i] * len(x) for i, x in enumerate(lattice.pieces))
    assert uses[lattice.pieces.index("ab")] > 0 and 0 < lengths <= sum(len(w) + 1 for w in words)


def test_lm_scores(odd, empty, small):
    assert lm_scores(empty).count() == 0
    low = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    for docs in (odd, small):
        rows = docs.select("doc_id", "text").collect()
        held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2
        words = [WORD.findall((d.text or "").translate(low)) for d in rows]
        c = collections.Counter(w for d, ws in zip(rows, words, strict=True) if not held(d.doc_id) for w in ws)
        ends = sum(not held(d.doc_id) for d in rows)
        n, v = sum(c.values()) + ends, len(c) + 1
        want = collections.Counter()
        for d, ws in zip(rows, words, strict=True):
            base = sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws) + math.log10((ends + 1) / (n + v + 1))
            want[(d.doc_id, held(d.doc_id), len(ws) + 1, sum(c[w] > 0 for w in ws) + 1, n, f"{base:.6g}")] += 1
        got = lm_scores(docs, chunk_chars=20_000).collect()
        assert collections.Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, f"{r.base_score:.6g}") for r in got) == want
        assert all(r.score < 0 for r in got)


def test_learning_raises_held_out_likelihood(small):
    mean = lambda d: d.filter("held_out").agg(F.sum("score") / F.sum("n_tokens")).first()[0]
    assert mean(lm_scores(small, rounds=2)) > mean(lm_scores(small, rounds=0))
    pieces, bytes_at, weights = vocabulary(tokenizer_path("piece_bpe_32k.model"))
    assert len(weights) == len(pieces) + 256 and len(bytes_at) == 256


# embeddings


def brute_vectors(rows, cosine=0.9):
    unit = []
    for r in rows:
        v = None if r[1] is None or any(x is None for x in r[1]) else np.array(r[1], float)
        ok = v is not None and len(v) and np.isfinite(v).all() and np.abs(v).max() > 0
        unit.append(v / np.linalg.norm(v) if ok else None)
    links = [[j for j in range(len(rows)) if j != i and unit[i] is not None and unit[j] is not None and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= cosine] for i in range(len(rows))]
    return links


def roots(links):
    out = list(range(len(links)))
    changed = True
    while changed:
        changed = False
        for i, near in enumerate(links):
            for j in near:
                if out[j] < out[i]:
                    out[i], changed = out[j], True
    return out


def test_embeddings(spark):
    rng = np.random.default_rng(0)
    base = rng.normal(size=(40, 8))
    rows = [(i, (base[i % 40] * (1 + i % 3) + rng.normal(size=8) * 0.15).tolist()) for i in range(300)]
    rows += [(300 + k, rows[k][1]) for k in range(10)] + [(310, None), (311, [0.0] * 8), (312, [1.0, None] + [0.0] * 6), (313, [float("nan")] + [1.0] * 7)]
    rows += [(314, [1.0, 2.0]), (315, [1.0, 2.0]), (316, []), (317, [1e300] * 8), (318, [1e-300] * 8)]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 AS label", "2 AS cls", "3 AS list")
    links = brute_vectors([(i, None if v is None else [None if x is None else x * (1e-290 if i == 317 else 1e290 if i == 318 else 1) for x in v]) for i, v in rows])
    root = roots(links)
    got = {r.vec_id: r for r in near_duplicates(d, sample_rows=100).collect()}
    assert len(got) == len(rows)
    for k, (i, _) in enumerate(rows):
        assert got[i].n_links == len(links[k]), i
        assert got[i].component_id == rows[root[k]][0] and got[i].kept == (got[i].component_id == i)
    assert near_duplicates(d.filter("1 = 0")).count() == 0


def test_bounds_keep_every_pair_of_the_look_ups():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(900, 24))
    x[300:600] = x[:300] + rng.normal(size=(300, 24)) * 0.05
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    index, reach = build(x, 9), float(np.sqrt(0.2))
    own, _ = index.assign(x)
    for c in range(len(index.coarse)):
        held = x[own == c]
        code, missed = index.encode(held - index.coarse[c])
        residual = x - index.coarse[c]
        total = sum(squared(residual[:, cols], book)[:, code[:, s]] for s, (cols, book) in enumerate(zip(index.columns, index.codes)))
        wanted = set(zip(*np.nonzero(np.sqrt(total) - missed <= reach)))
        got = set(zip(*Bounds(index.decoded(code), missed, reach).candidates(residual)))
        assert wanted <= got and len(got) <= len(wanted) + 5
        assert set(zip(*np.nonzero(x @ held.T >= 0.9))) <= got


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, k) for k in range(101, 140)] + [(7, 7)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(41)) and all(got[i] == 100 for i in range(100, 140))


# n-gram join


def shingles(text):
    w = WORD.findall(text or "")
    return frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()


def brute_join(rows):
    sets = [shingles(t) for _, t in rows]
    like = lambda a, b: a == b or 5 * len(a & b) >= 4 * len(a | b)
    return [[j for j in range(len(rows)) if j != i and like(sets[i], sets[j])] for i in range(len(rows))]


def near_copies(n, words, edits, start):
    rng = np.random.default_rng(start)
    text = [f"w{k}" for k in rng.integers(0, 10_000, words)]
    out = []
    for k in range(n):
        t = list(text)
        for e in rng.integers(0, words, edits):
            t[e] = f"x{k}"
        out.append(" ".join(t))
    return out


def test_join_equals_brute_force(odd, empty, spark):
    assert jaccard_join(empty).count() == 0 and deduplicated(empty).count() == 0
    texts = near_copies(30, 200, 1, 1) + near_copies(25, 120, 3, 2) + near_copies(20, 60, 2, 3) + near_copies(5, 90, 0, 4)
    made = spark.createDataFrame([(100 + k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    for docs in (odd, made, spark.read.parquet("/root/testdata/sf0.001/documents.parquet")):
        rows = [(d.doc_id, d.text) for d in docs.select("doc_id", "text").collect()]
        links = brute_join(rows)
        root = roots(links)
        groups = collections.defaultdict(list)
        for k, r in enumerate(root):
            groups[r].append(rows[k][0])
        name = {r: min((i for i in ids if i is not None), default=None) for r, ids in groups.items()}
        want = collections.Counter((i, len(links[k]), name[root[k]]) for k, (i, _) in enumerate(rows))
        for block in (128, 3):
            assert collections.Counter((r.doc_id, r.n_links, r.group_id) for r in jaccard_join(docs, block=block).collect()) == want
        kept = deduplicated(docs)
        assert kept.columns == docs.columns and kept.count() == len(groups)


def test_groups_without_a_name_of_their_own_keep_one_row_each(spark):
    texts = ["first clean text without id", "first clean text without id", "second clean text, nothing like it", "one text of the id", "quite another of it"]
    rows = [(None, texts[0]), (None, texts[1]), (None, texts[2]), (7, texts[3]), (7, texts[4]), (7, texts[4]), (9, texts[3])]
    kept = deduplicated(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.text) for r in kept) == [(0, texts[0]), (0, texts[2]), (7, texts[3]), (7, texts[4])]


def test_prefix_is_shortened_to_the_target():
    d = shortened(0.8, 16, 6, 0.999)
    assert 1 - (1 - 0.8**d) ** 16 >= 0.999 > 1 - (1 - 0.8 ** (d + 1)) ** 16


# toxicity and pipeline


def test_classifier_learns_words_and_stems():
    rng = np.random.default_rng(1)
    word = lambda: "".join(rng.choice(list("abcdefgh"), 5))
    texts, y = [], []
    for k in range(600):
        t = [word() for _ in range(60)]
        if k % 3 == 0:
            for _ in range(3):
                t[rng.integers(60)] = "zzbad" + word()[:2]
        texts.append(" ".join(t))
        y.append(float(k % 3 == 0))
    model, scores = train(texts, np.array(y), np.arange(600) % 4 == 0)
    held = np.array(y)[np.arange(600) % 4 == 0]
    assert ((scores >= 0.5) == held).mean() > 0.95
    assert calibrate(np.array([0.9] * 30 + [0.1] * 30), np.array([1.0] * 30 + [0.0] * 30), ["a"] * 60) == {"a": 0.5}


def test_toxicity_tables(odd, empty, spark, small):
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    none = labels.filter("1 = 0")
    assert toxicity(empty, labels).count() == 0
    assert all(r.score < 1e-3 for r in toxicity(odd, none).collect())
    got = toxicity(odd, labels).collect()
    assert len(got) == odd.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    assert all(r.held_out == (zlib.crc32(("" if r.doc_id is None else str(r.doc_id)).encode()) % 5 == 0) for r in got)


def test_thresholds_come_from_all_calibration_rows(spark):
    """A capped sample of equal shares sees other scores than the labels' real share gives."""
    rng = np.random.default_rng(3)
    word = lambda: "".join(rng.choice(list("abcdefgh"), 5))
    rows = []
    for k in range(4000):
        y = k % 10 == 0
        bad = rng.random() < (0.9 if y else 0.3)
        rows.append((k, " ".join([word() for _ in range(20)] + ["zzbad"] * bad + ["zzworse"] * (y and rng.random() < 0.5)), None if k % 3 else "en", int(y)))
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, toxic int").repartition(3)
    got = toxicity(d.drop("toxic"), d.select("doc_id", "toxic"), per_class=200).join(d.select("doc_id", "lang", "toxic", F.xxhash64("doc_id").alias("h")), "doc_id").collect()
    kept = [r for r in got if not r.held_out and zlib.crc32(str(r.h).encode()) % 4 == 0]
    assert len(kept) > 600
    for lang in ("en", None):
        s, y = np.array([(r.score, r.toxic) for r in kept if r.lang == lang]).T
        f1 = lambda c: 2 * ((s >= c) & (y == 1)).sum() / ((s >= c).sum() + (y == 1).sum())  # noqa: B023, E731
        (cut,) = {r.threshold for r in got if r.lang == lang}
        assert f1(cut) >= max(f1(c) for c in s) - 0.01


def test_pipeline_stages(odd, spark):
    sf = "/root/testdata/sf0.001"
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "ngram_join", "secret_scans", "mixing", "packing"]
    docs = odd
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf)
        assert docs.columns == odd.columns
    rows = corpus_pipeline.run(spark, sf)
    assert rows.count() > 0 and {"doc_id", "sequence_id", "offset"} <= set(rows.columns)


def test_signatures_tell_minima_apart_in_two_bytes():
    import numpy as np

    from pairloom.llm import op10_ngram_join as J

    fs, rng = J.factors(96), np.random.default_rng(5)
    sets = [np.unique(rng.integers(0, 1 << 63, 4000, dtype=np.uint64)) for _ in range(20)]
    sigs = np.stack([J.signature(s, fs) for s in sets])
    assert sigs.dtype == np.uint16 and sigs.nbytes == 20 * 96 * 2
    assert np.array_equal(J.signature(np.concatenate((sets[0], sets[1])), fs) == sigs[0], J.signature(np.union1d(sets[0], sets[1]), fs) == sigs[0])
    equal = [(sigs[a] == sigs[b]).mean() for a in range(20) for b in range(a)]
    assert np.mean(equal) < 0.001  # small minima of large sets keep no common leading bits
    near = np.concatenate((sets[0][:3600], sets[1][:400]))
    assert abs((J.signature(near, fs) == sigs[0]).mean() - 3600 / 4400) < 0.15
    assert J.signature(sets[0][:0], fs).dtype == np.uint16


def test_batches_to_python_are_short(spark, small):
    from pairloom.llm import common
    from pairloom.llm.op3_packing import pieces

    before = spark.conf.get(common.BATCH_SETTING)
    try:
        for asked, kept in ((10_000, common.BATCH_ROWS), (0, common.BATCH_ROWS), (50, 50)):
            spark.conf.set(common.BATCH_SETTING, asked)
            pieces(small)
            assert int(spark.conf.get(common.BATCH_SETTING)) == kept
    finally:
        spark.conf.set(common.BATCH_SETTING, before)
