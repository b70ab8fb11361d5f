"""The experiments: nine runs, four treatments, the BM25 grid, paired comparisons."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gleaner.functions.analysis import FIELDS, STOPWORDS
from gleaner.operators import evaluation, ranking, statistics
from gleaner.operators.index import TREATMENTS, Index, n_types

GRID_K1 = (0.6, 0.9, 1.2, 1.5, 2.0)
GRID_B = (0.0, 0.25, 0.5, 0.75, 1.0)
#: (key, run, against): fixed pairs; ``treat:`` names a treatment's run.
PAIRS = (
    ("bm25_vs_raw", "bm25|title", "tfidf_raw|title"),
    ("log_vs_raw", "tfidf_log|title", "tfidf_raw|title"),
    ("bm25_vs_log", "bm25|title", "tfidf_log|title"),
    ("desc_vs_title", "bm25|title_desc", "bm25|title"),
    ("narr_vs_title", "bm25|title_desc_narr", "bm25|title"),
    ("raw_narr_vs_title", "tfidf_raw|title_desc_narr", "tfidf_raw|title"),
    ("stem_vs_nostem", "treat:stem_stop", "treat:nostem_stop"),
    ("stop_vs_nostop", "treat:stem_stop", "treat:stem_nostop"),
)


#: Values of two small groups whose intervals SQL can follow.
SAMPLE = (("a", [0.0, 0.1, 0.25, 0.5, 0.5, 0.75, 0.9, 1.0]), ("b", [0.2, 0.0, 0.0, 0.0, 0.05, 0.4, 0.0, 0.6]))


def pair_label(a: str, b: str) -> str:
    """A heading made from the two runs' keys: what they share, then what differs."""
    if a.startswith("treat:"):
        return " / ".join(k.removeprefix("treat:") for k in (a, b))
    (r, f), (s, g) = a.split("|"), b.split("|")
    return f"{f}: {r} / {s}" if f == g else f"{r}: {f} / {g}"


@dataclass(frozen=True)
class Results:
    runs: DataFrame  # run_key, run_order, num, metrics, interp
    treatments: DataFrame  # treatment, num, metrics
    grid: DataFrame  # k1, b, map


def run_order(ranker, field):
    order = F.lit(0)
    for i, r in enumerate(ranking.RANKERS):
        for j, f in enumerate(FIELDS):
            order = F.when((ranker == r) & (field == f), 3 * i + j).otherwise(order)
    return order


def judged_topics(topics: DataFrame, qrels: DataFrame) -> DataFrame:
    """Topics that measures can be taken on; no other needs ranking."""
    return topics.join(evaluation.eval_topics(qrels).select("num"), "num", "left_semi")


def _measured(lists: DataFrame, qrels: DataFrame, keys: dict[str, list]) -> DataFrame:
    return evaluation.per_topic(lists, qrels, list(keys), checked=True, values=keys)


def judged_places(lists: DataFrame, index: Index, qrels: DataFrame) -> DataFrame:
    """Of the ranked documents the judged ones, with their names; no other counts for a measure."""
    judged = qrels.select("num", "docno").distinct().join(index.docs.select("doc_idx", "docno"), "docno").select("num", "doc_idx", "docno")
    return lists.join(judged, ["num", "doc_idx"])


def main_runs(topics: DataFrame, index: Index, qrels: DataFrame, treatment: str = "stem_stop", stopwords=STOPWORDS) -> DataFrame:
    """The nine runs by topic: ``run_key, run_order`` and measures."""
    lists = ranking.run_places(judged_topics(topics, qrels), index, tuple(FIELDS), ranking.RANKERS, (treatment,), stopwords=stopwords, ranks_only=True)
    rows = _measured(judged_places(lists, index, qrels), qrels, {"ranker": list(ranking.RANKERS), "field": list(FIELDS)})
    return rows.withColumn("run_key", F.concat_ws("|", "ranker", "field")).withColumn("run_order", run_order(F.col("ranker"), F.col("field")))


def treatment_runs(topics: DataFrame, index: Index, qrels: DataFrame, treatments=tuple(TREATMENTS), stopwords=STOPWORDS) -> DataFrame:
    lists = ranking.run_places(judged_topics(topics, qrels), index, ("title",), ("bm25",), treatments, stopwords=stopwords, ranks_only=True)
    return _measured(judged_places(lists, index, qrels), qrels, {"treatment": list(treatments)})


def grid(topics: DataFrame, index: Index, qrels: DataFrame, treatment: str = "stem_stop", stopwords=STOPWORDS) -> DataFrame:
    """``k1, b, map`` of 25 settings: 25 lists of each query from one reading of the documents' words."""
    q = ranking.analysed_queries(judged_topics(topics, qrels), ("title",), (treatment,), stopwords)
    cells = [(k1, b) for k1 in GRID_K1 for b in GRID_B]
    lists = ranking.best(q, index, [("bm25", *c) for c in cells], ranks_only=True).withColumnRenamed("variant", "cell")
    lists = judged_places(lists, index, qrels).select("num", "cell", "rank", "docno")
    rows = _measured(lists, qrels, {"cell": list(range(len(cells)))}).groupBy("cell").agg(F.avg("ap").alias("map"))
    name = lambda i: F.element_at(F.array(*[F.lit(c[i]) for c in cells]), F.col("cell") + 1)
    return rows.select(name(0).alias("k1"), name(1).alias("b"), "map")


def best_cell(cells: DataFrame) -> DataFrame:
    """The first setting with the largest MAP."""
    return cells.orderBy(F.desc(F.round("map", 9)), "k1", "b").limit(1)


def summaries(rows: DataFrame, keys: list[str]) -> DataFrame:
    """``metric, mean, lo, hi`` per key: intervals of all six measures."""
    each = F.array(*[F.struct(F.lit("map" if m == "ap" else m).alias("metric"), F.col(m).alias("value")) for m in evaluation.METRICS])
    return statistics.bootstrap(rows.select(*keys, "num", F.explode(each).alias("x")).select(*keys, "num", "x.*"), [*keys, "metric"])


def comparisons(main: DataFrame, treated: DataFrame, intervals: bool = True) -> DataFrame:
    """``key, label, mean_diff, lo, hi, wins, losses, ties``."""
    every = main.select("run_key", "num", "ap").unionByName(treated.select(F.concat(F.lit("treat:"), "treatment").alias("run_key"), "num", "ap"))
    pairs = main.sparkSession.createDataFrame([(i, *p, pair_label(*p[1:])) for i, p in enumerate(PAIRS)], "place int, key string, a string, b string, label string")
    side = lambda c: F.broadcast(pairs).join(every, F.col(c) == F.col("run_key")).select("key", "num", "ap")
    got = statistics.paired(side("a"), side("b"), ["key"])
    out = pairs.join(got, "key").select("place", "key", "a", "b", "label", "mean_diff", "wins", "losses", "ties", "diffs")
    if intervals:
        rows = got.select("key", F.posexplode("diffs").alias("num", "value"))
        out = out.join(statistics.bootstrap(rows, ["key"]).select("key", "lo", "hi"), "key")
    return out


def topic_table(main: DataFrame, topics: DataFrame) -> DataFrame:
    """Per topic: title, judgments, and the run with the best AP (the first of equals)."""
    best = Window.partitionBy("num").orderBy(F.desc(F.round("ap", 9)), "run_order")
    rows = main.withColumn("place", F.row_number().over(best)).where("place = 1")
    return rows.join(topics.select("num", "title"), "num").select("num", "title", "n_rel", "n_judged", F.col("run_key").alias("best_run"), F.col("ap").alias("best_ap"))


def ap_by_run(main: DataFrame) -> DataFrame:
    """AP of all topics, in topic order, per run."""
    return main.groupBy("run_key").agg(F.transform(F.array_sort(F.collect_list(F.struct("num", "ap"))), lambda e: e["ap"]).alias("ap"))


def treatment_table(treated: DataFrame, index: Index) -> DataFrame:
    types = n_types(index)
    return summaries(treated, ["treatment"]).where(F.col("metric").isin("map", "p10")).join(types, "treatment")


def zero_counts(main: DataFrame) -> DataFrame:
    """Per run: topics without any success, under 0.1 and over 0.9, and the median AP."""
    return main.groupBy("run_key").agg(
        F.count_if(F.col("ap") == 0).alias("n_zero"), F.count_if(F.col("ap") < 0.1).alias("n_below_01"), F.count_if(F.col("ap") > 0.9).alias("n_above_09"),
        F.percentile("ap", 0.5).alias("median_ap"),
    )


def dead_topics(main: DataFrame) -> DataFrame:
    """Topics on which every run fails."""
    return main.groupBy("num").agg(F.max("ap").alias("best"), F.count("*").alias("n_runs")).where("best = 0").select("num", "n_runs")


def grid_swing(cells: DataFrame) -> DataFrame:
    return cells.agg(F.min("map").alias("worst"), F.max("map").alias("best"), (F.max("map") - F.min("map")).alias("swing"))


def judged_differences(pairs: DataFrame, hairline: float = 0.0005) -> DataFrame:
    """Comparisons with flags: does the interval exclude zero, and only just?"""
    apart = (F.col("lo") > 0) | (F.col("hi") < 0)
    edge = F.least(F.abs("lo"), F.abs("hi"))
    return pairs.withColumn("excludes_zero", apart).withColumn("hairline", apart & (edge < hairline))


def sorted_differences(pairs: DataFrame) -> DataFrame:
    """``key, place, diff``: a comparison's differences by topic, the largest gain first."""
    return pairs.select("key", F.posexplode(F.sort_array("diffs", asc=False)).alias("place", "diff"))
