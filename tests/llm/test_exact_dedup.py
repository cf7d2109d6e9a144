"""Exact duplicates: against grouping by the text itself."""

import collections
import hashlib

import pytest

from pairloom.llm import op13_exact_dedup as exact


def expected(rows):
    groups = collections.defaultdict(list)
    for doc, text in rows:
        groups[text or ""].append(doc)
    want = collections.Counter()
    for text, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        for k, doc in enumerate(sorted(ids, key=lambda i: (i is None, -(i or 0)))):
            want[(doc, keep, len(ids), k == 0, hashlib.sha256(text.encode()).hexdigest())] += 1
    return want


def columns(got):
    return collections.Counter((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in got.collect())


def test_whole_table_and_odd_rows(odd, empty, small):
    assert exact.exact_groups(empty).count() == 0 and exact.deduplicated(empty).count() == 0
    for docs in (odd, small):
        rows = [(d.doc_id, d.text) for d in docs.select("doc_id", "text").collect()]
        assert columns(exact.exact_groups(docs)) == expected(rows)
        kept = exact.deduplicated(docs)
        assert kept.columns == docs.columns
        assert kept.count() == len({t or "" for _, t in rows})


def planted(spark):
    """Texts that only a later level tells apart, one group of half of all rows, repeated and NULL ids."""
    base = "x" * 80
    rows = [(k, "copy of everything") for k in range(120)] + [(None, "copy of everything"), (7, "copy of everything")]
    rows += [(k, f"{k:05d} same length") for k in range(200, 240)]  # length only
    rows += [(k, base + f"{k:05d}") for k in range(300, 340)]  # length and prefix
    rows += [(k, base + "00001") for k in range(400, 403)] + [(None, "no id"), (None, "no id"), (None, "n0 id")]
    return rows, spark.createDataFrame(rows, "doc_id long, text string").repartition(4)


@pytest.mark.parametrize("bound", [0, 200_000])
def test_levels_with_and_without_broadcast(spark, monkeypatch, bound):
    monkeypatch.setattr(exact, "BROADCAST_KEYS", bound)
    rows, docs = planted(spark)
    assert columns(exact.exact_groups(docs)) == expected(rows)
    assert exact.exact_groups(docs, digest=False).columns == ["doc_id", "keep_id", "group_size", "kept"]


def test_full_content_is_hashed_for_survivors_only(spark):
    rows, docs = planted(spark)
    seen = exact.refined(docs, "doc_id", "text", exact.PREFIX, False)
    assert seen.filter("full IS NOT NULL").count() == 122 + 40 + 3 + 2
    one = spark.createDataFrame([(1, "a"), (2, "bb"), (3, "ccc"), (4, "ddd")], "doc_id long, text string")
    levels = {r.doc_id: (r.head is None, r.full is None) for r in exact.refined(one, "doc_id", "text", 64, False).collect()}
    assert levels == {1: (True, True), 2: (True, True), 3: (False, True), 4: (False, True)}
