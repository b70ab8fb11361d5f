"""Bootstrap intervals, log-log fits, histograms."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.functions.analysis import histogram_bin

N_BOOT, SEED, TIE = 10_000, 20260912, 1e-9
DOC_LEN_BINS = (0, 50, 100, 150, 200, 300, 400, 500, 750, 1000, 1500, 2000, 3000, 5000)
POSTING_BINS = (1, 2, 3, 5, 9, 17, 33, 65, 129, 257, 513, 1025, 2049, 4097)


def interval(values, n_boot: int = N_BOOT, seed: int = SEED) -> dict[str, float]:
    """Mean and 95 % percentile interval; every call draws from the seed anew."""
    x = np.asarray(values, dtype=np.float64)
    if not len(x):
        return {"mean": 0.0, "lo": 0.0, "hi": 0.0}
    drawn = np.random.default_rng(seed).integers(0, len(x), size=(n_boot, len(x)))
    lo, hi = np.percentile(x[drawn].mean(axis=1), [2.5, 97.5])
    return {"mean": float(x.mean()), "lo": float(lo), "hi": float(hi)}


def bootstrap(rows: DataFrame, keys: list[str], value: str = "value", order: str = "num") -> DataFrame:
    """``mean, lo, hi`` per key of ``rows``; a group has a row per topic."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        got = interval(pdf.sort_values(order, kind="stable")[value])
        return pd.DataFrame([[*key, got["mean"], got["lo"], got["hi"]]], columns=[*keys, "mean", "lo", "hi"])

    types = dict(rows.dtypes)
    schema = ", ".join([*(f"`{k}` {types[k]}" for k in keys), "mean double, lo double, hi double"])
    return rows.groupBy(*keys).applyInPandas(run, schema)


def paired(a: DataFrame, b: DataFrame, keys: list[str], value: str = "ap") -> DataFrame:
    """``a - b`` per topic, summed up: mean difference, wins, losses, ties; both hold the same topics."""
    x = a.select(*keys, "num", F.col(value).alias("a")).join(b.select(*keys, "num", F.col(value).alias("b")), [*keys, "num"], "full")
    lone = F.raise_error(F.lit("the runs hold different topics")).cast("double")
    d = x.select(*keys, "num", F.when(F.col("a").isNotNull() & F.col("b").isNotNull(), F.col("a") - F.col("b")).otherwise(lone).alias("d"))
    tie = F.abs("d") < TIE
    return d.groupBy(*keys).agg(
        F.avg("d").alias("mean_diff"), F.count_if(~tie & (F.col("d") > 0)).alias("wins"), F.count_if(~tie & (F.col("d") < 0)).alias("losses"),
        F.count_if(tie).alias("ties"), F.transform(F.array_sort(F.collect_list(F.struct("num", "d"))), lambda e: e["d"]).alias("diffs"),
    )


def loglog_fit(points: DataFrame, x: str, y: str) -> DataFrame:
    """Least squares of log10 y on log10 x: ``slope, intercept``; zeros for fewer than two points."""
    lx, ly = F.log10(F.col(x)), F.log10(F.col(y))
    fit = points.agg(F.regr_slope(ly, lx).alias("slope"), F.regr_intercept(ly, lx).alias("intercept"))
    return fit.select(F.coalesce("slope", F.lit(0.0)).alias("slope"), F.coalesce("intercept", F.lit(0.0)).alias("intercept"))


def histogram(values: DataFrame, value: str, edges: Iterable[int]) -> DataFrame:
    """``bin, left_edge, n``: all bins, empty ones too."""
    e = list(edges)
    spark = values.sparkSession
    bins = spark.range(len(e)).select(F.col("id").cast("int").alias("bin"), F.element_at(F.array(*[F.lit(x) for x in e]), F.col("id").cast("int") + 1).alias("left_edge"))
    counts = values.groupBy(histogram_bin(F.col(value), e).alias("bin")).agg(F.count("*").alias("n"))
    return bins.join(counts, "bin", "left").select("bin", "left_edge", F.coalesce("n", F.lit(0)).alias("n"))
