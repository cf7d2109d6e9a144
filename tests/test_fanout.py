"""One pass over the rows where several results are made of them; matrices and key classes against plain counts."""

import collections

from pyspark.sql import functions as F

from pairloom.operators import aggregates as A
from pairloom.operators import joins as J
from pairloom.operators import metrics as M
from pairloom.operators import qa
from pairloom.plans import q_qa
from pairloom.sources import readers

SF = "/root/testdata/sf0.001"


def scans(df):
    return df._jdf.queryExecution().optimizedPlan().toString().count("Relation [")


def test_difference_tasks_read_their_input_once(spark):
    typed = q_qa.typed(spark, SF)
    assert scans(qa.difference_tasks(typed)) == scans(typed)


def test_task_records_read_their_input_once(spark):
    names = ["context", "shown", "only_left", "only_right", "left_repr", "right_repr", "right_code", "dataset_name", "endpoint", "source_index", "repre"]
    df = spark.createDataFrame([tuple("a.b" if n.startswith("only") else n for n in names)], ", ".join(f"{n} string" for n in names))
    made = qa.task_records(df)
    assert "Union" not in made._jdf.queryExecution().optimizedPlan().toString()
    got = {r.task: r for r in made.collect()}
    assert set(got) == {t.name for t in qa.TASKS}
    assert got["instructed"].step == "multi_step" and "Swap, one after the other, 'a.b' for 'a.b'." in got["instructed"].question


def test_feature_matrix_over_every_name(spark):
    rows = [(1, {"b": 2, "a": 1}), (2, {}), (3, {"z": 5}), (4, None)]
    df = spark.createDataFrame(rows, "id long, counts map<string,int>")
    names = A.vocabulary(df, "counts")
    assert [(r.name, r.idx) for r in names.orderBy("idx").collect()] == [("a", 0), ("b", 1), ("z", 2)]
    m = A.sparse_matrix(df, "id", "counts", names)
    dense = {r.id: list(r.vector) for r in A.dense_rows(m, "id").collect()}
    assert dense == {1: [1, 2, 0], 2: [0, 0, 0], 3: [0, 0, 5], 4: [0, 0, 0]}
    groups = list(A.wide_groups(m, "id", names, 2))
    assert [g.columns for g in groups] == [["id", "a", "b"], ["id", "z"]]
    assert {r.id: (r.a, r.b) for r in groups[0].collect()} == {1: (1, 2), 2: (0, 0), 3: (0, 0), 4: (0, 0)}


def test_histogram_moves_no_rows_on_its_group(spark):
    df = spark.range(1000).selectExpr("IF(id % 10 = 0, 'a', NULL) AS g", "CAST(id AS double) AS v")
    d = A.density_histogram(df, "v", "g", 10)
    plan = d._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    assert d.agg(F.sum("n")).first()[0] == 1000


def test_classes_are_the_pairs_counted(spark):
    rows = [("d", k % 2, f"r{k // 3}", f"k{k % 4}" if k % 5 else "") for k in range(60)]
    df = spark.createDataFrame(rows, "ds string, label int, repr string, f string")
    for compat in (False, True):
        pairs = collections.Counter((r.ds, r.f) for r in J.pairs_sharing_key(df, ["ds"], "f", compat=compat).collect())
        assert {(r.ds, r.f): r.n_pairs for r in J.classes_sharing_key(df, ["ds"], "f", compat=compat).collect()} == pairs


def test_each_gate_of_the_best_cases_drops_a_row(spark):
    features = [(i, 0.9, 0.5, 0.5, 0.0, 0.0, 0.0, left, right) for i, left, right in ((1, "x", "y"), (2, "x.z", "y"), (3, "x", ""), (4, "x", "y"))]
    features[3] = (4, 0.61, *features[3][2:])
    columns = "source_index long, sim double, shared_atoms double, shared_bonds double, atom_gap double, bond_gap double, ring_gap double, only_left string, only_right string"
    preds = [(i, "t", step, "m", "A", p, c) for i in range(1, 6) for step in ("single_step", "multi_step") for p, c in ((" a", None), ("B", None), ("B", 1))]
    preds = spark.createDataFrame(preds, "source_index long, task string, step string, model string, gold string, pred string, correct int")
    got = M.best_cases(preds, spark.createDataFrame(features, columns), k=9).collect()
    kept = collections.Counter((r.step, r.source_index) for r in got)
    # wrong answers, pairs under the gate, unknown pairs, and single steps with other than one fragment a side are gone
    assert kept == {("single_step", 1): 2, ("multi_step", 1): 2, ("multi_step", 2): 2, ("multi_step", 3): 2}


def test_plain_csv_is_split(spark, tmp_path):
    (tmp_path / "a.csv").write_text("text\n" + "row\n" * 5000)
    for quoted in (True, False):
        spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
        try:
            d = readers.load_directory(spark, [str(tmp_path)], "csv", "text string", quoted_lines=quoted)
            assert d.count() == 5000 and (d.rdd.getNumPartitions() > 1) is not quoted
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
