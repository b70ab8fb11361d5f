"""Readers of TREC files: SGML collections, topics, judgments, stopwords, checksums."""

from __future__ import annotations

import html

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from gleaner.functions.analysis import clean_headline, collapse, iso_date, strip


@F.pandas_udf(T.StringType())
def unescape(s: pd.Series) -> pd.Series:
    """Character references of HTML 5, decoded."""
    return s.map(html.unescape, na_action="ignore")


def _first(body: Column, tag: str) -> Column:
    return F.regexp_extract(body, rf"(?s)<{tag}>(.*?)</{tag}>", 1)


def _every(body: Column, tag: str) -> Column:
    return F.regexp_extract_all(body, F.lit(rf"(?s)<{tag}>(.*?)</{tag}>"), 1)


def parse_sgml(files: DataFrame) -> DataFrame:
    """``docno, date, headline, text`` (and ``file``, where there is one) of the DOC records in ``files(value)``; a record without DOCNO, DATE or TEXT is an error."""
    about = [F.col("file")] if "file" in files.columns else []
    body = files.select(*about, F.explode(F.regexp_extract_all("value", F.lit(r"(?s)<DOC>(.*?)</DOC>"), 1)).alias("body"))
    rows = body.select(
        *about,
        strip(_first(F.col("body"), "DOCNO")).alias("docno"), _first(F.col("body"), "DATE").alias("date"),
        _first(F.col("body"), "HEADLINE").alias("headline"), _every(F.col("body"), "TEXT").alias("texts"),
    )
    whole = (F.col("docno") != "") & (strip(F.col("date")) != "") & (F.size("texts") > 0)
    missing = F.concat(F.lit("record without DOCNO, DATE or TEXT: "), F.col("docno"))
    text = F.when(whole, F.array_join("texts", "\n")).otherwise(F.raise_error(missing).cast("string"))
    return rows.select("docno", iso_date(F.col("date")).alias("date"), clean_headline(unescape("headline")).alias("headline"), strip(unescape(text)).alias("text"), *about)


def with_positions(docs: DataFrame, order: Column, span: int = 1 << 16) -> DataFrame:
    """Add ``doc_idx``, dense from 0 in the order of a whole number; documents without a number come last.

    Numbers are counted on their own: they add up within spans, spans add up what comes before them, and
    the result joins the documents, so texts aren't sorted and no task holds all rows. Only where numbers
    repeat do their documents get an order among themselves (by all their columns)."""
    rows = docs.withColumn("_n", F.coalesce(order.cast("long"), F.lit((1 << 63) - 1)))
    numbers = rows.groupBy("_n").agg(F.count("*").alias("_size")).withColumn("_span", F.floor(F.col("_n") / span))
    sizes = numbers.groupBy("_span").agg(F.sum("_size").alias("_s"))
    before = Window.orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)  # a row per span
    starts = sizes.select("_span", F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_start"))
    inner = Window.partitionBy("_span").orderBy("_n").rowsBetween(Window.unboundedPreceding, -1)  # a span holds ``span`` numbers at most
    numbers = numbers.select("_n", "_span", "_size", F.coalesce(F.sum("_size").over(inner), F.lit(0)).alias("_inner")).join(starts, "_span")
    at = numbers.select("_n", (F.col("_start") + F.col("_inner")).alias("_at"))
    placed = rows.join(at.hint("shuffle_hash"), "_n")  # texts are dealt out once and never sorted
    place = F.col("_at")
    if not numbers.where("_size > 1").isEmpty():
        place = place + F.row_number().over(Window.partitionBy("_n").orderBy(*[F.col(c) for c in docs.columns])) - 1
    return placed.withColumn("doc_idx", place.cast("long")).drop("_n", "_at")


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """A directory of SGML files as ``doc_idx, docno, date, headline, text, file``, by the number in the docno."""
    try:
        files = spark.read.text(path, wholetext=True).select("value", F.col("_metadata.file_name").alias("file"))
        empty = files.isEmpty()
    except Exception as e:
        raise FileNotFoundError(f"no SGML collection can be read from {path}") from e
    if empty:
        raise FileNotFoundError(f"the folder {path} holds no files")
    docs = parse_sgml(files)
    return with_positions(docs, F.element_at(F.split("docno", "-"), 2)).select("doc_idx", "docno", "date", "headline", "text", "file")


def parse_topics(files: DataFrame) -> DataFrame:
    """``num, title, desc, narr`` of ``<top>`` blocks; a field runs to the next tag and may begin with its label."""
    top = files.select(F.explode(F.regexp_extract_all("value", F.lit(r"(?s)<top>(.*?)(?:</top>|\z)"), 1)).alias("t"))

    def field(tag: str, label: str) -> Column:
        found = F.regexp_extract_all("t", F.lit(rf"(?s)<{tag}>\s*(?:{label}:)?(.*?)(?=<|\z)"), 1)
        return F.when(F.size(found) > 0, collapse(F.get(found, 0))).otherwise(F.raise_error(F.lit(f"topic without <{tag}>")).cast("string"))

    num = F.regexp_extract("t", r"(?s)<num>\s*(?:Number:)?\s*(\d+)", 1)
    num = F.when(num == "", F.raise_error(F.lit("topic without a number")).cast("string")).otherwise(num)
    return top.select(num.cast("int").alias("num"), field("title", "Topic").alias("title"), field("desc", "Description").alias("desc"), field("narr", "Narrative").alias("narr"))


def parse_qrels(lines: DataFrame, docnos: DataFrame | None = None) -> DataFrame:
    """``num, docno, rel`` (0 or 1) of ``lines(line_no, value)``: four columns a line, of repeated pairs the last counts."""
    rows = lines.where(strip(F.col("value")) != "").select("line_no", F.split(strip(F.col("value")), r"\s+").alias("c"))
    bad = F.raise_error(F.concat(F.lit("not four columns: "), F.array_join("c", " "))).cast("array<string>")
    rows = rows.select("line_no", F.when(F.size("c") == 4, F.col("c")).otherwise(bad).alias("c"))
    rows = rows.select("line_no", F.col("c")[0].cast("int").alias("num"), F.col("c")[2].alias("docno"), (F.col("c")[3].cast("int") > 0).cast("int").alias("rel"))
    out = rows.groupBy("num", "docno").agg(F.max(F.struct("line_no", "rel")).alias("x")).select("num", "docno", F.col("x.rel").alias("rel"))
    return out if docnos is None else out.join(docnos.select("docno").distinct(), "docno", "left_semi").select("num", "docno", "rel")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """``line_no, value`` of one file."""
    whole = spark.read.text(path, wholetext=True)
    return whole.select(F.posexplode(F.split("value", "\r?\n")).alias("line_no", "value"))


def stopwords(spark: SparkSession, path: str) -> list[str]:
    """Distinct words of a file with one word a line, sorted. A list of words is small by nature."""
    rows = spark.read.text(path).select(F.lower(strip(F.col("value"))).alias("w")).where("w <> ''").distinct()
    return sorted(r["w"] for r in rows.collect())


def verify_checksums(spark: SparkSession, path: str, sums: str) -> DataFrame:
    """``name, expected, actual, ok`` of the files that the list ``sums`` names."""
    want = spark.read.text(sums).where("trim(value) <> ''").select(F.split(F.trim("value"), r"\s+").alias("c"))
    want = want.select(F.regexp_extract(F.regexp_replace(F.col("c")[1], r"^\*", ""), r"([^/]*)$", 1).alias("name"), F.lower(F.col("c")[0]).alias("expected"))
    have = spark.read.format("binaryFile").load(path).select(F.regexp_extract("path", r"([^/]*)$", 1).alias("name"), F.sha2("content", 256).alias("actual"))
    return want.join(have, "name", "left").withColumn("ok", F.coalesce(F.col("expected") == F.col("actual"), F.lit(False)))


def require_checksums(spark: SparkSession, path: str, sums: str) -> int:
    """Number of files that agree; all that don't are named in one error."""
    rows = verify_checksums(spark, path, sums).collect()
    bad = sorted(r["name"] for r in rows if not r["ok"])
    if bad:
        raise ValueError(f"missing or changed files: {', '.join(bad)}")
    return len(rows)
