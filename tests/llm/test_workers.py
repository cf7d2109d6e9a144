"""What Python workers hold and how often rows are moved or handled."""

import time

import numpy as np
import pyarrow as pa

from pairloom.llm import common
from pairloom.llm.op8_toxicity import _Words, train


def test_a_task_that_does_not_ask_drops_what_earlier_ones_kept(monkeypatch):
    monkeypatch.setattr(common, "_kept", {})
    first = common.begun(lambda: common.kept("encoder", list))
    assert common.begun(lambda: common.kept("encoder", list)) is first
    assert common.begun(lambda: 1) == 1 and not common._kept


def test_tables_of_words_grow_in_place():
    texts = [f"word{i} common token{i % 7}" for i in range(600)]
    labels = np.arange(600) % 2.0
    model, _ = train(texts, labels, np.arange(600) % 4 == 0, epochs=1)
    words = _Words(model)
    words.texts(texts[:300])
    held = [t for per in words.tables for t in per]
    found = words.texts(texts)
    assert not words.new and all(a is b for a, b in zip(held, [t for per in words.tables for t in per], strict=True))
    for per, mine in zip(words.tables, model.tables(model.emb), strict=True):
        for t, own in zip(per, mine, strict=True):
            assert np.array_equal(t[found[450][0]], own[model.part_rows("word450")].sum(axis=0))


def test_narrow_batches_are_put_together(spark):
    def make():
        return lambda batch: pa.record_batch([pa.array([batch.num_rows])], names=["n"])

    rows = spark.range(0, 5000, 1, 1)
    assert [r.n for r in common.map_rows(rows, "n long", make, 50_000).collect()] == [5000]
    assert max(r.n for r in common.map_rows(rows, "n long", make).collect()) <= common.BATCH_ROWS
    batches = [pa.record_batch([pa.array(range(k))], names=["n"]) for k in (3, 4, 5, 6)]
    assert [b.num_rows for b in common.joined(iter(batches), 7)] == [7, 11]
    assert [b.num_rows for b in common.joined(iter(batches), 100, most=1)] == [3, 4, 5, 6]


def test_shards_are_split_and_read_without_scattered_copies():
    from pairloom.llm.op9_token_files import Shard, pack_shard

    ids = np.random.default_rng(3).integers(0, 1 << 16, 1 << 20).astype(np.uint32)

    def seconds(work):
        took = []
        for _ in range(3):
            t = time.process_time()
            work()
            took.append(time.process_time() - t)
        return min(took)

    def by_masks():  # what splitting a shard by masks takes, without packing, compression and directory
        x = ids.astype(np.uint16)
        for k in range(15, -1, -1):
            bit = (x >> k) & 1 == 1
            x = np.concatenate((x[~bit], x[bit]))

    assert seconds(lambda: pack_shard(ids, [len(ids)], [1])) < seconds(by_masks)
    assert np.array_equal(Shard(pack_shard(ids, [len(ids)], [1])).ids(), ids)


def test_sets_are_dealt_once(spark, small):
    from pyspark.sql import functions as F

    from pairloom.llm import op10_ngram_join as J

    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
        wanted = common.staged(J.signatures(small, "doc_id", "text", 5, 96).select("rid", "cls", F.lit(1).alias("m"), "sig"))
        sets = J.shingle_sets(small, wanted, "doc_id", "text", 5)
        plan = sets._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 2  # the wanted row keys, and the sets by class
        assert {bytes(r.cls) for r in sets.collect()} == {bytes(r.cls) for r in wanted.collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
