"""The supplied tables as a collection: documents are the corpus, benchmark passages the topics."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from gleaner.functions.analysis import tokens
from gleaner.operators.words import lean, split
from gleaner.sources.trec import with_positions


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_idx, docno, headline, text``; positions follow doc_id."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    docs = with_positions(docs, F.col("doc_id"))
    return docs.select("doc_idx", F.concat(F.lit("D"), "doc_id").alias("docno"), F.substring_index(F.col("text"), "\n", 1).alias("headline"), "text", "doc_id")


def topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``num, title, desc, narr``: the first, second and further sentences of a passage."""
    b = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select(F.col("item_id").alias("num"), F.split("text", r"\. ", -1).alias("p"))
    part = lambda i: F.coalesce(F.get(F.col("p"), i), F.lit(""))
    return b.select("num", part(0).alias("title"), part(1).alias("desc"), F.array_join(F.slice("p", 3, 1 << 20), " ").alias("narr"))


def qrels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``num, docno, rel``. Judged are the documents that hold the rarest inner word of a topic's passage;
    relevant those that hold the passage word for word (which are among them). A passage of fewer than three
    words has no inner word and no judgments. Texts are read twice where they lie, for the words' document counts and
    for the judgments, and never exchanged; passages and their words' counts are collected."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    cores = spark.sparkContext.defaultParallelism
    if len(docs.inputFiles()) < cores:
        docs = docs.select("doc_id", "text").repartition(cores)  # a file may be one row group, which one task reads
    lowered = F.lower(F.coalesce("text", F.lit(""))).cast("binary").alias("lowered")
    docs = docs.select(F.concat(F.lit("D"), "doc_id").alias("docno"), F.col("text").cast("binary").alias("text"), lowered)
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select(F.col("item_id").alias("num"), F.col("text").alias("passage"))
    num = items.schema["num"].dataType.simpleString()
    found = tokens(F.col("passage"))
    inner = F.array_distinct(F.slice(found, 2, F.greatest(F.size(found) - 2, F.lit(0))))
    asked = [(r["num"], bytes(r["passage"]), r["inner"]) for r in items.select("num", F.col("passage").cast("binary").alias("passage"), inner.alias("inner")).collect() if r["inner"]]
    wanted = {w.encode() for _, _, inner_words in asked for w in inner_words}

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: Counter = Counter()
        for b in batches:
            for text in b["lowered"].to_pylist():
                n.update(wanted.intersection(split(text)))
        yield pa.RecordBatch.from_arrays([pa.array([w.decode() for w in n], pa.string()), pa.array(list(n.values()), pa.int64())], ["term", "n"])

    df = {r["term"]: r["df"] for r in docs.select("lowered").mapInArrow(lean(counts), "term string, n long").groupBy("term").agg(F.sum("n").alias("df")).collect()}
    topics_of: dict[bytes, list[tuple]] = {}
    for n, passage, inner_words in asked:
        if known := [(df[w], w) for w in inner_words if w in df]:
            topics_of.setdefault(min(known)[1].encode(), []).append((n, passage))
    rarest = set(topics_of)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for docno, text, low in zip(b["docno"].to_pylist(), b["text"].to_pylist(), b["lowered"].to_pylist(), strict=True):
                rows += [(n, docno, int(passage in text)) for w in rarest.intersection(split(low)) for n, passage in topics_of[w]]
            yield pa.RecordBatch.from_pylist([dict(zip(kinds.names, r, strict=True)) for r in rows], kinds)

    kinds = to_arrow_schema(T.StructType.fromDDL(f"num {num}, docno string, rel int"))
    return docs.mapInArrow(lean(judge), f"num {num}, docno string, rel int")
