import json

import pytest
from pyspark.sql import functions as F

from pairloom.functions import parsing, strings
from pairloom.operators import aggregates as A
from pairloom.operators import choices, joins
from pairloom.operators.features import encode, register_encoder
from pairloom.schema import require_columns
from pairloom.sources import incremental, readers, writers


@pytest.mark.parametrize(
    "gold,pred,em,prf",
    [
        ("", "", 0.0, (1, 1, 1)),
        ("", "a", 0.0, (0, 1, 0)),
        ("a.b", "", 0.0, (0, 0, 0)),
        ("a.b", "b . a", 1.0, (1, 1, 1)),
        ("a.a.b", "a.b", 0.0, (1, 1, 1)),
        ("a.b", "a.c", 0.0, (0.5, 0.5, 0.5)),
    ],
)
def test_fragment_metrics(spark, gold, pred, em, prf):
    df = spark.createDataFrame([(gold, pred)], "g string, p string")
    m = strings.set_precision_recall_f1(F.col("g"), F.col("p"))
    r = df.select(strings.same_multiset(F.col("g"), F.col("p")).alias("em"), *[c.alias(n) for n, c in m.items()]).first()
    assert r.em == em and (r.precision, r.recall, r.f1) == prf


@pytest.mark.parametrize("n", [1, 2])
def test_char_precision(spark, n):
    from collections import Counter

    cases = [("abca", "aab"), ("", "a"), ("a", ""), ("a b", "b a"), ("[C]+.", "+C]"), ("aaaa", "aa")]
    df = spark.createDataFrame(cases, "g string, p string")
    got = [r[0] for r in df.select(strings.char_precision(F.col("g"), F.col("p"), n)).collect()]
    for (g, p), value in zip(cases, got):
        g, p = g.replace(" ", ""), p.replace(" ", "")
        a = Counter(g[i : i + n] for i in range(len(g) - n + 1))
        b = Counter(p[i : i + n] for i in range(len(p) - n + 1))
        want = sum(min(c, a[t]) for t, c in b.items()) / sum(b.values()) if a and b else 0.0
        assert value == pytest.approx(want)


def test_labels(spark):
    rows = [("1",), ("1.0",), ("yes",), ("N",), ("maybe",), (None,), ("2",), (" False ",)]
    got = [r[0] for r in spark.createDataFrame(rows, "y string").select(readers.binary_label(F.col("y"))).collect()]
    assert got == [1, 1, 1, 0, None, None, None, 0]


def test_lenient_json(spark):
    cases = ["plain", 'x {"a": 1} y', '{"a": 1}', '{"a": 1} {"b": 2}', "", None]
    df = spark.createDataFrame([(c,) for c in cases], "t string")
    got = [r[0] for r in df.select(parsing.json_object_in(F.col("t"))).collect()]
    assert got == [None, '{"a": 1}', '{"a": 1}', None, None, None]
    inner = json.dumps({"answer": json.dumps({"answer": "B"})})
    outer = json.dumps({"answer": json.dumps({"step": "s"}), "x": 1})
    df = spark.createDataFrame([(inner,), (outer,), ('{"answer": " C "}',), ("D",), (None,)], "t string")
    got = [r[0] for r in df.select(parsing.answer_of(F.col("t"))).collect()]
    assert got == ["B", '{"step": "s"}', "C", "D", ""]
    df = spark.createDataFrame([("{'a': [(1, 2), (3,)]}",), ("nan",), ("{broken",)], "t string")
    got = [r[0] for r in df.select(parsing.literal_as(F.col("t"), "map<string,array<array<int>>>")).collect()]
    assert got[0] == {"a": [[1, 2], [3]]} and not got[1] and not got[2]


def test_fences_on_edges(spark):
    df = spark.createDataFrame([(None, 5.0), (None, 5.0), (None, 5.0)], "a double, b double")
    fences = A.iqr_fences(df, ["a", "b"])
    assert [(r.property, r.lower_fence, r.upper_fence) for r in fences.collect()] == [("b", 5.0, 5.0)]
    flagged = A.flag_outliers(df, fences, ["a", "b"])
    assert flagged.filter("is_outlier").count() == 0


def test_key_pairs_and_their_compat_mode(spark):
    rows = [("e", 1, "a", "f"), ("e", 0, "b", "f"), ("e", 1, "c", "f"), ("e", 0, "c", "f"), ("e", 1, "d", "")]
    df = spark.createDataFrame(rows, "ep string, label int, repr string, key string")
    assert {(r.left_repr, r.right_repr) for r in joins.pairs_sharing_key(df, ["ep"], "key").collect()} == {("a", "b")}
    compat = joins.pairs_sharing_key(df, ["ep"], "key", compat=True)
    assert {(r.left_repr, r.right_repr) for r in compat.collect()} == {("a", "b"), ("a", "c")}


def test_choices_on_tiny_pools(spark):
    q = spark.createDataFrame([(1, "x", "a"), (2, None, "b"), (3, "y", "zz")], "id long, endpoint string, answer string")
    pool = spark.createDataFrame([("x", "a"), ("x", "b"), ("x", "c"), ("y", "d"), ("y", " ")], "endpoint string, value string")
    for r in choices.with_distractors(q, pool).collect():
        assert len(r.choices) == 4 and r.choices[r.answer_index] == r.answer
        assert len(set(r.choices) - {r.answer}) == 3


def test_failing_values_become_rows(spark):
    import pandas as pd

    def fn(s):
        if (s == "bad").any():
            raise ValueError("no")
        return pd.DataFrame({"n": s.str.len()})

    register_encoder("len", fn, "n long")
    df = spark.createDataFrame([("a",), ("bad",), ("ccc",)], "value string").coalesce(1)
    assert {r.value: (r.status, r.n) for r in encode(df, "len").collect()} == {"a": ("ok", 1), "bad": ("error", None), "ccc": ("ok", 3)}


def test_files(spark, tmp_path):
    (tmp_path / "tox.csv").write_text("X,Task,Y\nCC,t1,1\nCO,t2,0\n")
    (tmp_path / "skip.csv").write_text("X,Task,Y\nCN,t1,1\n")
    (tmp_path / "a.tsv").write_text("Drug_ID\tDrug\tY\n1\tC\t1\n")
    assert readers.load(spark, str(tmp_path / "a.tsv")).columns == ["Drug_ID", "Drug", "Y"]
    with pytest.raises(ValueError):
        readers.load(spark, str(tmp_path / "a.bin"))
    raw = readers.load_directory(spark, [str(tmp_path / "*.csv")], "csv", "X string, Task string, Y string", ["skip"])
    assert {(r.dataset_name, r.endpoint, r.X) for r in raw.collect()} == {("tox", "t1", "CC"), ("tox", "t2", "CO")}
    (tmp_path / "bad.txt").write_text("a,b\n1,2\n3\n4,5,6,7\n8,9\n")
    tolerant = readers.load_tolerant_csv(spark, str(tmp_path / "bad.txt"), "a int, b int")
    assert tolerant.count() == 3
    assert sorted(map(tuple, tolerant.collect())) == [(1, 2), (3, None), (8, 9)]
    (tmp_path / "p.jsonl").write_text('{"id": 1, "pred": "a"}\n\nnot json\n{"id": 2, "pred": " "}\n')
    done = readers.load_records(spark, str(tmp_path / "p.jsonl"), "id long, pred string")
    assert done.count() == 2 and sorted(r.id for r in done.collect()) == [1, 2]
    todo = incremental.pending(spark.range(4), done.withColumn("is_error", F.lit(False)))
    assert sorted(r.id for r in todo.collect()) == [0, 2, 3]
    assert incremental.pending(spark.range(4), done, reset=True).count() == 4
    deep = tmp_path / "tree" / "x"
    deep.mkdir(parents=True)
    (deep / "summary_run3_icl2.json").write_text(json.dumps({"model": "m", "accuracy": 0.5}))
    s = readers.load_summaries(spark, str(tmp_path / "tree"), "model string, accuracy double").first()
    assert (s.run, s.shots, s.accuracy) == (3, 2, 0.5)
    out = str(tmp_path / "out")
    writers.write_by_endpoint(raw, out)
    back = spark.read.parquet(out)
    assert {(r.dataset, r.endpoint_dir) for r in back.collect()} == {("tox", "t1"), ("tox", "t2")}
    writers.write_records(raw.select("X", "endpoint"), str(tmp_path / "rec"), ("endpoint",))
    assert spark.read.json(str(tmp_path / "rec")).count() == 2
    with pytest.raises(ValueError):
        require_columns(raw, ["nope"])


def test_dataset_names_of_folders_and_quoted_lines(spark, tmp_path):
    from pairloom.sources import readers

    d = spark.createDataFrame([("a",), ("b",)], "text string").repartition(2)
    d.write.parquet(str(tmp_path / "my data.v2.parquet"))
    d.write.option("header", True).csv(str(tmp_path / "other set.csv"))
    (tmp_path / "one.v3.csv").write_text('text\n"first\nsecond"\nthird\n')
    got = readers.load_directory(spark, [str(tmp_path / "my data.v2.parquet")], "parquet", "text string").collect()
    assert {r.dataset_name for r in got} == {"my data.v2"}
    got = readers.load_directory(spark, [str(tmp_path / "other set.csv"), str(tmp_path / "one.v3.csv")], "csv", "text string").collect()
    assert {(r.dataset_name, r.text) for r in got} == {("other set", "a"), ("other set", "b"), ("one.v3", "first\nsecond"), ("one.v3", "third")}
    assert readers.load(spark, str(tmp_path / "one.v3.csv")).count() == 2


def test_census_keys_a_value_once(spark):
    rows = [("a", "x", 1), ("a", "x", 1), ("a", "y", 1), ("b", "x", 1), ("b", "x", 2), (None, "x", 2), (None, None, None), ("b", None, 3)]
    d = spark.createDataFrame(rows, "p string, q string, v int")
    sets = [["p", "q"], ["p"], ["q"], []]
    got = A.census(d, sets, ["p", "q"], "n", {"n_v": "v", "n_p": "p"})
    want = {}
    for p, q, v in rows:
        for s, bits in zip(sets, (0, 1, 2, 3)):
            n = want.setdefault((p if "p" in s else None, q if "q" in s else None, bits), [0, set(), set()])
            n[0] += 1
            n[1] |= {v} - {None}
            n[2] |= {p} - {None}
    assert {(r.p, r.q, r.grouping): (r.n, r.n_v, r.n_p) for r in got.collect()} == {k: (n, len(v), len(p)) for k, (n, v, p) in want.items()}
    assert "Expand" not in got._jdf.queryExecution().toString()
    assert A.census(d.filter("1 = 0"), sets, ["p", "q"], "n", {"n_v": "v"}).count() == 0
