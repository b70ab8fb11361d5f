"""A corpus pipeline of five stages; each works on all that the one before kept.

The quality stage drops documents that the classifier rejects. The near-duplicate stage keeps the
smallest doc_id of each group (five words, a similarity of 0.8). Personal data is replaced. Mixing
reads every document once or more, by its source's weight. Packing deals the mixture into batches.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.llm import minhash, mixing, packing, pii, quality
from gleaner.llm.common import shared_dir, table, unused

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Trained on the labelled documents of ``sf_dir``; scores ``docs``. Null and empty texts are scored as empty;
    without labels all rows score 0.5 and go."""
    net = quality.fit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    name = unused(docs, "quality_score")
    kept = quality.score(docs, net, name=name).where(F.col(name) >= quality.NetParams().keep_at)
    return kept.select(*docs.columns)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows of the documents that stay. Rows that agree in doc_id and text are one; different texts under one
    doc_id are parts of one document and all stay or go. Rows without doc_id stay."""
    found = minhash.near_duplicates(docs).where("kept").select("doc_id").distinct()
    named = docs.join(found, "doc_id", "left_semi").select(*docs.columns).dropDuplicates(["doc_id", "text"])
    return named.unionByName(docs.where("doc_id IS NULL"))


def private_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row, with surrogates in its text and n_chars counted anew; null texts stay null."""
    return pii.pseudonymise(docs).withColumn("n_chars", F.char_length("text").cast("long")).select(*docs.columns)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row once or more, by its source; a null source is a source, empty texts weigh one token."""
    return mixing.mix(docs).select(*docs.columns)


def batches(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row for each row; null and empty texts have length 0."""
    return packing.pack(docs)


STAGES = [
    ("quality", good_quality),
    ("near duplicates", one_of_each),
    ("personal data", private_data),
    ("mixing", mixture),
    ("packing", batches),
]

#: SQL can't train or apply the quality stage's network.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(*COLUMNS)
    for name, stage in STAGES:
        path = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}/{name.replace(' ', '_')}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
