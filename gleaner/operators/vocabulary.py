"""Corpus and vocabulary statistics: funnel, Heaps and Zipf curves, stem groups, top lists, summaries."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gleaner.functions.analysis import STOPWORDS, raw_tokens, tokens, unnested, without
from gleaner.functions.porter import stem_map
from gleaner.operators.index import Index
from gleaner.operators.statistics import loglog_fit

HEAPS_POINTS, HEAPS_START = 40, 1000
ZIPF_HEAD, ZIPF_TAIL_POINTS, ZIPF_FIT_RANKS = 10, 50, 1000


def funnel(docs: DataFrame, stopwords: Iterable[str] = STOPWORDS, stemmed: bool = True) -> DataFrame:
    """``step, n_types, n_tokens`` after each step of the analysis, from one count of raw tokens."""
    words = unnested(docs, raw_tokens(F.col("text")), "term").groupBy("term").agg(F.count("*").alias("n"))
    digit, stop = F.col("term").rlike("[0-9]"), F.col("term").isin(list(stopwords))
    steps = [("raw_alpha", F.lit(True), F.col("term")), ("minus_digits", ~digit, F.col("term")), ("minus_stopwords", ~digit & ~stop, F.col("term"))]
    if stemmed:
        words = words.join(stem_map(words.where(~digit & ~stop)), "term", "left")
        steps.append(("stemmed", ~digit & ~stop, F.col("stem")))
    cases = F.array(*[F.when(on, F.struct(F.lit(k).alias("step"), word.alias("word"))) for k, on, word in steps])
    rows = unnested(words, cases, "x", "n").groupBy("x.step", "x.word").agg(F.sum("n").alias("n"))
    return rows.groupBy("step").agg(F.count("*").alias("n_types"), F.sum("n").alias("n_tokens"))


def checkpoints(total: int, points: int = HEAPS_POINTS, start: int = HEAPS_START) -> list[int]:
    """Evenly spaced on a log scale, and the total."""
    if total <= 0:
        return []
    if total <= start:
        return [total]
    return sorted({*(int(round(x)) for x in np.geomspace(start, total, points)), total})


def heaps_points(docs: DataFrame, stopwords: Iterable[str] = STOPWORDS, lengths: DataFrame | None = None) -> DataFrame:
    """``n_tokens, n_types`` along the unstemmed, stopped stream in document order. A word counts from its
    first place; places are document offsets plus positions, so nothing is walked in one task. ``lengths``
    may give ``doc_idx, doc_len`` of the stream's documents."""
    length = F.size(without(tokens(F.col("text")), stopwords)).cast("long")
    sizes = docs.select("doc_idx", length.alias("n")) if lengths is None else lengths.select("doc_idx", F.col("doc_len").alias("n"))
    sizes = sizes.withColumn("span", F.floor(F.col("doc_idx") / 4096))
    spans = sizes.groupBy("span").agg(F.sum("n").alias("s"))
    before = F.coalesce(F.sum("s").over(Window.orderBy("span").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row per 4096 documents
    inner = F.coalesce(F.sum("n").over(Window.partitionBy("span").orderBy("doc_idx").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.withColumn("inner", inner).join(spans.select("span", before.alias("before")), "span").select("doc_idx", (F.col("before") + F.col("inner")).alias("start"))
    placed = docs.select("doc_idx", "text").join(starts, "doc_idx").select("start", without(tokens(F.col("text")), stopwords).alias("w"))
    places = placed.select("start", F.posexplode_outer("w").alias("pos", "term")).where("term IS NOT NULL")
    first = places.groupBy("term").agg(F.min(F.col("start") + F.col("pos") + 1).alias("at"))  # partial minima meet, not places
    total = sizes.agg(F.sum("n").alias("n")).first()["n"] or 0
    points = checkpoints(total)
    if not points:
        return docs.sparkSession.createDataFrame([], "n_tokens long, n_types long")
    marks = F.array(*[F.lit(p).cast("long") for p in points])
    slot = F.size(F.filter(marks, lambda m: m < F.col("at")))
    counts = first.groupBy(slot.alias("slot")).agg(F.count("*").alias("n"))
    rows = docs.sparkSession.createDataFrame(list(enumerate(points)), "slot int, n_tokens long").join(counts, "slot", "left")
    upto = Window.orderBy("slot")  # forty rows
    return rows.select("n_tokens", F.sum(F.coalesce("n", F.lit(0))).over(upto).alias("n_types"))


def heaps_fit(points: DataFrame) -> DataFrame:
    """V = k * N ** beta."""
    fit = loglog_fit(points, "n_tokens", "n_types")
    n = points.agg(F.count("*").alias("n"))
    return fit.crossJoin(n).select(F.when(F.col("n") < 2, 0.0).otherwise(F.pow(F.lit(10.0), "intercept")).alias("k"), F.when(F.col("n") < 2, 0.0).otherwise(F.col("slope")).alias("beta"))


def ranked_terms(term_stats: DataFrame, upto: int | None = None) -> DataFrame:
    """``rank, term, df, cf`` by falling cf, then by term. Terms are numbered within their cf and first three
    letters, and counts of those add up what is above, so neither the vocabulary nor its half of words that
    occur once meets in one task."""
    head = F.substring("term", 1, 3)
    sizes = term_stats.groupBy("cf", head.alias("head")).agg(F.count("*").alias("n"))
    of_cf = sizes.groupBy("cf").agg(F.sum("n").alias("n"))
    above = F.coalesce(F.sum("n").over(Window.orderBy(F.desc("cf")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row per distinct cf
    starts = of_cf.select("cf", above.alias("start"))
    if upto is not None:
        starts = starts.where(F.col("start") < upto)
    inner = F.coalesce(F.sum("n").over(Window.partitionBy("cf").orderBy("head").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row per three letters
    starts = sizes.select("cf", "head", inner.alias("inner")).join(starts, "cf").select("cf", "head", (F.col("start") + F.col("inner")).alias("start"))
    place = F.row_number().over(Window.partitionBy("cf", "head").orderBy("term"))
    rows = term_stats.withColumn("head", head).join(starts, ["cf", "head"]).select((F.col("start") + place).alias("rank"), "term", "df", "cf")
    return rows if upto is None else rows.where(F.col("rank") <= upto)


def zipf_ranks(n: int) -> list[int]:
    head = list(range(1, min(n, ZIPF_HEAD) + 1))
    if n <= ZIPF_HEAD:
        return head
    tail = {int(round(x)) for x in np.geomspace(ZIPF_HEAD + 1, n, ZIPF_TAIL_POINTS)}
    return sorted({*head, *tail})


def zipf_points(term_stats: DataFrame) -> DataFrame:
    ranks = zipf_ranks(term_stats.count())
    return ranked_terms(term_stats).where(F.col("rank").isin(ranks)).select("rank", "term", "cf")


def zipf_fit(term_stats: DataFrame) -> DataFrame:
    return loglog_fit(ranked_terms(term_stats, ZIPF_FIT_RANKS), "rank", "cf")


def top_terms(term_stats: DataFrame, n: int = 25) -> DataFrame:
    return term_stats.orderBy(F.desc("cf"), "term").limit(n).select("term", "cf", "df")


def longest_postings(term_stats: DataFrame, n: int = 20) -> DataFrame:
    return term_stats.orderBy(F.desc("df"), "term").limit(n).select("term", "df", "cf")


def stem_groups(surface: DataFrame, stemmed: DataFrame, n: int = 12, words: int = 8) -> DataFrame:
    """``stem, n_words, stem_cf, place, term, cf``: stems that join most words, with their commonest words."""
    rows = surface.join(stem_map(surface.select("term")), "term").select("stem", "term", "cf")
    groups = rows.groupBy("stem").agg(F.count("*").alias("n_words")).join(stemmed.select(F.col("term").alias("stem"), F.col("cf").alias("stem_cf")), "stem")
    best = groups.orderBy(F.desc("n_words"), F.desc("stem_cf"), "stem").limit(n)
    place = F.row_number().over(Window.partitionBy("stem").orderBy(F.desc("cf"), "term"))
    return rows.join(F.broadcast(best), "stem").withColumn("place", place).where(F.col("place") <= words).select("stem", "n_words", "stem_cf", "place", "term", "cf")


def posting_summary(term_stats: DataFrame) -> DataFrame:
    return term_stats.agg(
        F.count("*").alias("n_terms"), F.sum("df").alias("n_postings"), F.avg("df").alias("mean_len"), F.percentile("df", 0.5).alias("median_len"),
        F.max("df").alias("max_len"), F.avg((F.col("df") == 1).cast("double")).alias("df1_share"),
    )


def doc_len_summary(doc_stats: DataFrame) -> DataFrame:
    part = lambda q: F.percentile("doc_len", q)
    return doc_stats.agg(F.avg("doc_len").alias("mean"), part(0.5).alias("median"), part(0.1).alias("p10"), part(0.9).alias("p90"), F.max("doc_len").alias("max"))


def corpus_summary(docs: DataFrame) -> DataFrame:
    """``n_docs, total_tokens_alpha``, and where documents have them: files, dates and headlines."""
    has = lambda c, *made: [*made] if c in docs.columns else []
    more = has("file", F.countDistinct("file").alias("n_files"))
    more += has("date", F.min("date").alias("date_min"), F.max("date").alias("date_max"), F.countDistinct("date").alias("n_dates"))
    more += has("headline", F.count_if(F.col("headline") != "").alias("n_headlines"))
    return docs.select("*", F.size(tokens(F.col("text"))).alias("_n")).agg(F.count("*").alias("n_docs"), F.sum("_n").alias("total_tokens_alpha"), *more)


def heaps_residual(points: DataFrame) -> DataFrame:
    """``residual``: how far the fitted curve is from the points at most, in powers of ten."""
    fit = heaps_fit(points)
    off = F.abs(F.log10("n_types") - F.log10(F.col("k") * F.pow("n_tokens", F.col("beta"))))
    return points.crossJoin(fit).agg(F.coalesce(F.max(off), F.lit(0.0)).alias("residual"))  # forty rows and one


def zipf_fitted(points: DataFrame, fit: DataFrame) -> DataFrame:
    """``rank, term, cf, fitted``: the frequency that the fitted line gives to a rank."""
    return points.crossJoin(fit).select("rank", "term", "cf", F.pow(F.lit(10.0), F.col("intercept") + F.col("slope") * F.log10("rank")).alias("fitted"))  # one row


def one(index: Index, treatment: str) -> Index:
    """An index cut down to one treatment."""
    pick = lambda df: df.where(F.col("treatment") == treatment)
    return Index(index.docs, pick(index.postings), pick(index.doc_stats), pick(index.term_stats), pick(index.collection), pick(index.norms))


FUNNEL_STEPS = ("raw_alpha", "minus_digits", "minus_stopwords", "stemmed")


def funnel_drops(steps: DataFrame) -> DataFrame:
    """Per step of a funnel: the share of tokens and types that it keeps, and whether it loses most tokens."""
    place = F.array_position(F.array(*[F.lit(s) for s in FUNNEL_STEPS]), F.col("step"))
    by = Window.orderBy(place)  # four rows
    rows = steps.select("step", "n_types", "n_tokens", F.lag("n_types").over(by).alias("t0"), F.lag("n_tokens").over(by).alias("n0"))
    drop = F.col("n0") - F.col("n_tokens")
    most = F.max(drop).over(Window.partitionBy())
    return rows.select("step", (F.col("n_tokens") / F.col("n0")).alias("kept_tokens"), (F.col("n_types") / F.col("t0")).alias("kept_types"), F.coalesce(drop == most, F.lit(False)).alias("largest_drop"))


def zipf_verdict(fit: DataFrame) -> DataFrame:
    """flat, near 1, or steep, by the fitted slope."""
    s = -F.col("slope")
    return fit.select("slope", "intercept", F.when(s < 0.95, "flat").when(s > 1.05, "steep").otherwise("near 1").alias("verdict"))


def trimmed(bins: DataFrame) -> DataFrame:
    """A histogram without the empty bins at its end."""
    last = bins.where("n > 0").agg(F.max("bin").alias("last"))
    return bins.crossJoin(last).where("bin <= last").drop("last")  # one row
