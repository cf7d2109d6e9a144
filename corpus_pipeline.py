"""A training-data pipeline over ``documents``: filter, deduplicate, redact, mix, pack.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again
as the next one's input. All but the last return the columns of their input.

* toxicity: rows whose score reaches their language's calibrated threshold go; the classifier is fitted on
  the labelled training rows of the stage's own input.
* ngram_join: of each group of documents linked by 80 % common five-word shingles one stays.
* secret_scans: every span of a secret, found at any depth of encoding, is replaced by its kind in brackets;
  all documents stay, ``n_chars`` follows the text.
* mixing: documents are repeated or left out so that sources reach their target weights.
* packing: token sequences of 1024; a row per piece.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairloom.llm.common import staged, table
from pairloom.llm.op1_secret_scans import redact
from pairloom.llm.op3_packing import packed
from pairloom.llm.op5_mixing import mixed
from pairloom.llm.op8_toxicity import fit, scored, threshold
from pairloom.llm.op10_ngram_join import deduplicated


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = fit(docs, table(spark, sf_dir, "labels"))
    name = "_score"
    while name in docs.columns:
        name += "_"
    rejected = F.col(name) >= threshold(model, F.col("lang"))
    return scored(docs, model, name=name).filter(~rejected).drop(name)


def ngram_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return deduplicated(docs)


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return redact(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixed(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packed(docs)


STAGES = [
    ("toxicity", toxicity),
    ("ngram_join", ngram_join),
    ("secret_scans", secret_scans),
    ("mixing", mixing),
    ("packing", packing),
]

ORACLE_SQL = None  # a trained classifier, decoding and packing are not SQL; tests hold the stages against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder; each stage's result is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir))
    return docs
