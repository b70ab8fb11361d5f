"""Shared helpers: tables, durable intermediate results, keyed hashes."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a maximal run of characters other than space and \t \n \v \f \r.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all machines share: ``spark.checkpoint.dir``, or where that is unset the warehouse's. Only a
    session whose executors are threads of the driver gets a temporary folder, made once."""
    context = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not found and context.master.startswith("local"):
        found = tempfile.mkdtemp(prefix="gleaner-")
        context.setCheckpointDir(found)
    if not found:
        found = spark.conf.get("spark.sql.warehouse.dir") + "/_intermediate"
    return found.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    The lineage ends there, so a lost executor costs a re-read and not a recomputation, and every
    consumer sees the same rows.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/gleaner-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def unused(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` doesn't have."""
    have = {c.lower() for c in df.columns}
    name = stem
    while name.lower() in have:
        name = f"_{name}"
    return name


def n_words(text: Column) -> Column:
    """Number of words of a text (0 for null)."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def keyed_hash(key: str, *parts: Column) -> Column:
    """60 bits of a keyed MD5 as a non-negative long; the same in any engine."""
    joined = F.concat_ws("\x1f", F.lit(key), *[F.coalesce(p.cast("string"), F.lit("\x00")) for p in parts])
    return F.conv(F.substring(F.md5(joined), 1, 15), 16, 10).cast("long")


def ascii_lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
