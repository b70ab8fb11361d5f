"""Measures of ranked lists against judgments, per topic, and their summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

METRICS = ("ap", "p10", "ndcg10", "rprec", "recall100", "judged10")


def eval_topics(qrels: DataFrame) -> DataFrame:
    """Topics with a relevant document: ``num, n_rel, n_judged``."""
    return qrels.groupBy("num").agg(F.sum("rel").alias("n_rel"), F.count("*").alias("n_judged")).where("n_rel > 0")


def qrels_counts(qrels: DataFrame) -> DataFrame:
    by = qrels.groupBy("num").agg(F.sum("rel").alias("n_rel"))
    sums = by.agg(F.count_if(F.col("n_rel") > 0).alias("n_topics"), F.count("*").alias("n_topics_all"), F.coalesce(F.sum("n_rel"), F.lit(0)).alias("n_rel_total"), F.count_if(F.col("n_rel") == 1).alias("n_single_rel_topics"))
    return sums.crossJoin(qrels.agg(F.countDistinct("docno").alias("n_judged_docs")))  # one row each


def _discounts(n):
    """Sum of 1/log2(r + 1) over ranks 1..n."""
    return F.aggregate(F.sequence(F.lit(1), n.cast("int")), F.lit(0.0), lambda a, r: a + F.lit(1.0) / F.log2(r + 1))


def _no_repeats(run: DataFrame, by: list[str]) -> DataFrame:
    """The run; reading it fails if a document is twice in a list."""
    twice = F.raise_error(F.concat(F.lit("a document is twice in the list of topic "), F.col("num").cast("string"))).cast("int")
    again = Window.partitionBy(*by, "docno").orderBy("rank")
    return run.withColumn("rank", F.when(F.row_number().over(again) == 1, F.col("rank")).otherwise(twice))


def per_topic(run: DataFrame, qrels: DataFrame, keys: list[str], p_at: int = 10, ndcg_at: int = 10, recall_at: int = 100, checked: bool = False, values: dict[str, list] | None = None) -> DataFrame:
    """``num, ap, p10, ndcg10, rprec, recall100, judged10, interp`` for each of the run's keys and each
    topic with a relevant document; topics without a list get zeros. A document twice in a list is an error;
    ``checked`` says that the lists hold none. ``values`` names the keys' values, so that a run without any hit
    has its zeros too and the lists are read once. All measures follow from the judged documents' ranks, so
    only those leave the join."""
    topics = eval_topics(qrels)
    by = [*keys, "num"]
    hits = (run if checked else _no_repeats(run, by)).join(qrels, ["num", "docno"]).join(topics.select("num", "n_rel"), "num")
    upto = Window.partitionBy(*by).orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    hits = hits.select(*by, "rank", "n_rel", F.col("rel").alias("r"), F.sum("rel").over(upto).alias("h"))
    first = F.col("rank") <= F.lit(p_at)
    precision = F.col("h") / F.col("rank")
    n = F.col("n_rel")
    levels = [F.coalesce(F.max(F.when((F.col("r") == 1) & (F.col("h") * 10 >= n * i), precision)), F.lit(0.0)) for i in range(11)]
    got = hits.groupBy(*by).agg(
        (F.sum(F.when(F.col("r") == 1, precision).otherwise(0.0)) / F.first("n_rel")).alias("ap"),
        (F.sum(F.when(first, F.col("r")).otherwise(0)) / F.lit(float(p_at))).alias("p10"),
        F.sum(F.when((F.col("rank") <= ndcg_at) & (F.col("r") == 1), F.lit(1.0) / F.log2(F.col("rank") + 1)).otherwise(0.0)).alias("dcg"),
        (F.sum(F.when(F.col("rank") <= n, F.col("r")).otherwise(0)) / F.first("n_rel")).alias("rprec"),
        (F.sum(F.when(F.col("rank") <= recall_at, F.col("r")).otherwise(0)) / F.first("n_rel")).alias("recall100"),
        (F.sum(F.when(first, F.lit(1)).otherwise(0)) / F.lit(float(p_at))).alias("judged10"),
        F.array(*levels).alias("interp"),
    )
    every = topics.select("num", "n_rel", "n_judged")
    if values is not None:
        for k in keys:
            every = every.withColumn(k, F.explode(F.array(*[F.lit(v) for v in values[k]])))
    elif keys:
        every = every.crossJoin(F.broadcast(run.select(*keys).distinct()))  # keys name a few runs
    out = every.join(got, by, "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0)).alias(c)
    ndcg = F.coalesce(F.col("dcg") / _discounts(F.least(F.lit(ndcg_at), F.col("n_rel"))), F.lit(0.0)).alias("ndcg10")
    return out.select(
        *by, "n_rel", "n_judged", zero("ap"), zero("p10"), ndcg, zero("rprec"), zero("recall100"), zero("judged10"),
        F.coalesce("interp", F.array(*[F.lit(0.0)] * 11)).alias("interp"),
    )


def means(topic_rows: DataFrame, keys: list[str]) -> DataFrame:
    return topic_rows.groupBy(*keys).agg(F.count("*").alias("n_topics"), *[F.avg(m).alias("map" if m == "ap" else m) for m in METRICS])


def mean_curve(topic_rows: DataFrame, keys: list[str]) -> DataFrame:
    """Mean interpolated precision at the eleven recall levels."""
    rows = topic_rows.select(*keys, F.posexplode("interp").alias("level", "p"))
    return rows.groupBy(*keys, "level").agg(F.avg("p").alias("precision"))
