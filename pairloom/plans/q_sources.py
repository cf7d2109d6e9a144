"""Sources, sinks and incremental re-runs on the driver tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from pairloom.operators.setops import first_rows
from pairloom.plans.frames import SQL_LABELLED, SQL_PREDICTIONS, labelled, predictions
from pairloom.plans.registry import query, table
from pairloom.session import cut, ensure_checkpoint_dir
from pairloom.sources import incremental, readers, writers


def scratch(spark, name):
    """A new folder in the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


@query(
    "S1_load_by_extension",
    "SELECT doc_id, quality, toxic FROM labels",
)
def s1(spark, sf):
    return readers.load(spark, f"{sf}/labels.parquet", schema="doc_id long, quality int, toxic int")


@query(
    "S2_raw_directory",
    """WITH raw AS (
      SELECT 'documents' AS dataset_name, text FROM documents
      UNION ALL SELECT 'conversations', text FROM conversations)
    SELECT dataset_name, dataset_name AS endpoint, count(*) AS n_rows,
           count(DISTINCT text) AS n_distinct FROM raw GROUP BY ALL""",
)
def s2(spark, sf):
    paths = [f"{sf}/{n}.parquet" for n in ("documents", "benchmark", "conversations")]
    raw = readers.load_directory(spark, paths, "parquet", "text string", excluded=["benchmark"])
    return raw.groupBy("dataset_name", "endpoint").agg(
        F.count(F.lit(1)).alias("n_rows"), F.countDistinct("text").alias("n_distinct")
    )


@query(
    "S3_column_inference",
    "SELECT p_partkey AS entity_id, p_name AS repr, p_size % 2 AS label FROM part",
)
def s3(spark, sf):
    raw = table(spark, sf, "part").select(
        F.col("p_partkey").alias("entity_id"), F.col("p_name").alias("Drug"), (F.col("p_size") % 2).alias("Target")
    )
    return readers.with_standard_names(raw)


_RAW_LABELS = """CASE o_orderkey % 9 WHEN 0 THEN '1' WHEN 1 THEN ' Yes' WHEN 2 THEN '1.0' WHEN 3 THEN 'N '
 WHEN 4 THEN 'maybe' WHEN 5 THEN 'FALSE' WHEN 6 THEN '2' WHEN 7 THEN o_orderstatus ELSE '0.0' END"""


@query(
    "S4_label_normalisation",
    f"""WITH raw AS (SELECT o_orderkey, {_RAW_LABELS} AS y FROM orders),
    t AS (SELECT o_orderkey, lower(trim(y)) AS v FROM raw),
    lab AS (SELECT o_orderkey, CASE WHEN v IN ('1','true','yes','y') OR try_cast(v AS DOUBLE) = 1 THEN 1
           WHEN v IN ('0','false','no','n') OR try_cast(v AS DOUBLE) = 0 THEN 0 END AS label FROM t)
    SELECT o_orderkey, CAST(label AS INTEGER) AS label FROM lab WHERE label IS NOT NULL""",
)
def s4(spark, sf):
    raw = table(spark, sf, "orders").select("o_orderkey", F.expr(_RAW_LABELS).alias("y"))
    return raw.select("o_orderkey", readers.binary_label(F.col("y")).alias("label")).filter(
        "label is not null"
    )


@query(
    "S5_clean_keyed",
    """WITH r AS (SELECT nullif(user_id % 50, 7) AS user_key, event_type, props, event_id,
        coalesce(try_cast(regexp_extract(props, '[0-9]+') AS DOUBLE), 0) AS k,
        coalesce(try_cast(event_type AS DOUBLE), 0) AS bad_number,
        row_number() OVER (PARTITION BY user_id % 50 ORDER BY event_id) AS rn FROM events)
    SELECT user_key, event_id, event_type, k, bad_number FROM r WHERE rn = 1 AND user_key IS NOT NULL""",
)
def s5(spark, sf):
    e = table(spark, sf, "events").select(
        F.nullif(F.col("user_id") % 50, F.lit(7)).alias("user_key"),
        "event_id",
        "event_type",
        F.regexp_extract("props", "[0-9]+", 0).alias("k"),
        F.col("event_type").alias("bad_number"),
    )
    return readers.clean_keyed(e, "user_key", ["k", "bad_number"], ["event_id"])


@query(
    "S5_tolerant_csv",
    """SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_comment_like END AS note
    FROM (SELECT o_orderkey, o_orderstatus || ', ' || o_orderpriority AS o_comment_like FROM orders) WHERE o_orderkey % 7 <> 0""",
)
def s5_csv(spark, sf):
    """Lines of a CSV file: every seventh has a field too many, every fifth lacks its last one."""
    key = F.col("o_orderkey")
    note = F.concat(F.lit('"'), "o_orderstatus", F.lit(", "), "o_orderpriority", F.lit('"'))
    line = F.when(key % 7 == 0, F.concat(key, F.lit(","), note, F.lit(",surplus"))).when(key % 5 == 0, key.cast("string"))
    path = scratch(spark, "tolerant")
    table(spark, sf, "orders").select(line.otherwise(F.concat(key, F.lit(","), note)).alias("value")).write.option("lineSep", "\n").text(path)
    return readers.load_tolerant_csv(spark, path, "o_orderkey long, note string", header=False)


@query(
    "S6_json_records",
    """SELECT event_id, CAST(regexp_extract(props, '"k": ([0-9]+)', 1) AS BIGINT) AS k
       FROM events WHERE event_type <> 'error'""",
)
def s6(spark, sf):
    """Records as lines of a text file: those of error rows are cut short, so they are left out when read."""
    e = table(spark, sf, "events")
    line = F.to_json(F.struct("event_id", F.get_json_object("props", "$.k").cast("long").alias("k")))
    path = scratch(spark, "records")
    e.select(F.when(F.col("event_type") == "error", F.substring(line, 1, 4)).otherwise(line).alias("value")).write.text(path)
    return readers.load_records(spark, path, "event_id long, k long")


_REL = "concat('task', {t}, '/out/', {r}, '/', {s}, '/results/predictions_', {m}, '.jsonl')"


@query(
    "S7_path_metadata",
    f"""WITH {SQL_PREDICTIONS}, p AS (
      SELECT id, CASE WHEN turn % 3 = 0 THEN 'subtask1' ELSE task END AS task, repre, step, model FROM predictions)
    SELECT id, task, CASE WHEN task = 'subtask1' THEN '' ELSE repre END AS repre,
           CASE WHEN task = 'subtask1' THEN '' ELSE step END AS step, model FROM p""",
)
def s7(spark, sf):
    p = predictions(spark, sf)
    task = F.when(F.col("turn") % 3 == 0, "subtask1").otherwise(F.col("task"))
    rel = F.concat(task, F.lit("/out/"), "repre", F.lit("/"), "step", F.lit("/results/predictions_"), "model", F.lit(".jsonl"))
    return readers.path_fields(p.select("id", rel.alias("path")), F.col("path")).select(
        "id", "task", "repre", "step", "model"
    )


@query(
    "S8_run_numbers",
    """SELECT page_id, CASE WHEN page_id % 4 = 0 THEN 0 ELSE CAST(page_id % 4 AS INTEGER) END AS run,
       CASE WHEN page_id % 3 = 0 THEN 0 ELSE CAST(page_id % 3 * 2 AS INTEGER) END AS shots FROM pages""",
)
def s8(spark, sf):
    p = table(spark, sf, "pages")
    run = F.when(F.col("page_id") % 4 == 0, "").otherwise(F.concat(F.lit("_run"), F.col("page_id") % 4))
    icl = F.when(F.col("page_id") % 3 == 0, "").otherwise(F.concat(F.lit("_icl"), F.col("page_id") % 3 * 2))
    named = p.select("page_id", F.concat(F.lit("summary"), run, icl, F.lit(".json")).alias("file"))
    return readers.run_numbers(named, readers.file_stem(F.col("file"))).select("page_id", "run", "shots")


@query(
    "S8_summary_tree",
    f"""WITH {SQL_PREDICTIONS} SELECT model, CAST(conv_id % 4 AS INTEGER) AS run, CAST(conv_id % 3 * 2 AS INTEGER) AS shots, count(*) AS total,
      round(avg(length(pred)), 6) AS mean_length FROM predictions GROUP BY ALL""",
)
def s8_tree(spark, sf):
    """Summaries are written as a tree of JSON files, a folder for each model, and read back as one table."""
    p = predictions(spark, sf).withColumns({"run": F.col("conv_id") % 4, "shots": F.col("conv_id") % 3 * 2})
    sums = p.groupBy("model", "run", "shots").agg(F.count(F.lit(1)).alias("total"), F.avg(F.length("pred")).alias("mean_length"))
    sums = cut(sums)
    root = scratch(spark, "summaries")
    for r in sums.select("model", "run", "shots").collect():  # one row a file
        name = f"summary_run{r.run}_icl{r.shots}.json" if r.run else f"summary_icl{r.shots}.json"
        one = sums.filter((F.col("model") == r.model) & (F.col("run") == r.run) & (F.col("shots") == r.shots))
        one.select("model", "total", "mean_length").coalesce(1).write.json(f"{root}/{r.model}/{name}")
    d = readers.load_summaries(spark, root, "model string, total long, mean_length double")
    return d.select("model", "run", "shots", "total", F.round("mean_length", 6).alias("mean_length"))


@query(
    "S9_partition_names",
    """WITH s AS (SELECT page_id, regexp_replace(trim(url), '[/\\\\:;|?*<>"\\n\\t]', '_', 'g') AS a FROM pages),
    t AS (SELECT page_id, regexp_replace(regexp_replace(a, '_{2,}', '_', 'g'), '^[._ ]+|[._ ]+$', '', 'g') AS b FROM s)
    SELECT page_id, CASE WHEN b = '' THEN 'unknown' ELSE b END AS folder FROM t""",
)
def s9(spark, sf):
    return table(spark, sf, "pages").select("page_id", writers.path_name(F.col("url")).alias("folder"))


@query(
    "S9_partitioned_write",
    """SELECT lang AS dataset, replace(source, 'src', 's_') AS endpoint_dir, count(*) AS n_rows, sum(doc_id)::BIGINT AS key_sum FROM documents GROUP BY ALL""",
)
def s9_write(spark, sf):
    """Written to a folder per dataset and endpoint, names made path-safe, and read back by partition."""
    d = table(spark, sf, "documents").select("doc_id", F.col("lang").alias("dataset_name"), F.replace("source", F.lit("src"), F.lit("s::?")).alias("endpoint"))
    path = scratch(spark, "by-endpoint")
    writers.write_by_endpoint(d, path)
    back = spark.read.parquet(path)
    return back.groupBy("dataset", "endpoint_dir").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("doc_id").alias("key_sum"))


_SPLIT_TYPE = "CASE WHEN l_returnflag = 'N' THEN 'unseen_endpoint_test' ELSE 'train_test' END"
_SPLIT = "CASE WHEN l_returnflag = 'N' OR l_orderkey % 5 = 0 THEN 'test' ELSE 'train' END"


@query(
    "S10_merge_split_tables",
    f"""WITH t AS (SELECT *, {_SPLIT_TYPE} AS split_type, {_SPLIT} AS split FROM lineitem)
    SELECT split, split_type, l_returnflag, count(*) AS n_rows, sum(l_orderkey)::BIGINT AS key_sum
    FROM t GROUP BY ALL""",
)
def s10(spark, sf):
    path = scratch(spark, "split-tables")
    t = table(spark, sf, "lineitem").select("l_orderkey", "l_returnflag", F.expr(_SPLIT_TYPE).alias("split_type"), F.expr(_SPLIT).alias("split"))
    t.write.partitionBy("split_type", "split").parquet(path)
    train, test = writers.read_split_tables(spark, path)
    return (
        train.unionByName(test)
        .groupBy("split", "split_type", "l_returnflag")
        .agg(F.count(F.lit(1)).alias("n_rows"), F.sum("l_orderkey").alias("key_sum"))
    )


@query(
    "S11_record_lines",
    f"""WITH {SQL_LABELLED} SELECT entity_id, '{{"id":' || entity_id || ',"dataset_name":"' || dataset_name
      || '","endpoint":"' || endpoint || '","answer":{{"answer":' || label || '}}}}' AS line FROM labelled""",
)
def s11(spark, sf):
    e = labelled(spark, sf)
    record = F.struct(
        F.col("entity_id").alias("id"), "dataset_name", "endpoint", F.struct(F.col("label").alias("answer")).alias("answer")
    )
    path = scratch(spark, "record-lines")
    writers.write_records(e.select(record.alias("r")).select("r.*"), path)
    lines = spark.read.text(path).withColumnRenamed("value", "line")
    return lines.select(F.get_json_object("line", "$.id").cast("long").alias("entity_id"), "line")


@query(
    "S12_pending_inputs",
    f"""WITH {SQL_PREDICTIONS} SELECT id, model FROM predictions
    WHERE NOT (turn % 2 = 0 AND conv_id % 5 <> 1 AND length(trim(pred)) > 200)""",
)
def s12(spark, sf):
    p = predictions(spark, sf)
    done = p.filter("turn % 2 = 0").select(
        "id",
        (F.col("conv_id") % 5 == 1).alias("is_error"),
        F.when(F.length(F.trim("pred")) > 200, F.col("pred")).otherwise("  ").alias("pred"),
    )
    return incremental.pending(p, done).select("id", "model")


@query(
    "S13_unseen_strings",
    """SELECT DISTINCT text AS value FROM documents d WHERE NOT EXISTS (
      SELECT 1 FROM documents s WHERE s.doc_id % 3 = 0 AND s.text = d.text)""",
)
def s13(spark, sf):
    d = table(spark, sf, "documents").select(F.col("text").alias("value"), "doc_id")
    return incremental.unseen(d, d.filter("doc_id % 3 = 0"), "value")
