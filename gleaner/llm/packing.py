"""Packing by optimal length buckets.

The exact global histogram of document lengths goes to a dynamic program that chooses the bucket
boundaries with the least total padding; inside each bucket, documents are dealt into batches whose
padded size stays within a token budget. D distinct lengths add up to D**2 / 2 tokens or more, so the
histogram has at most sqrt(2 * tokens) rows: some 6 million (100 MB) for 100 TB of text.

Edge cases: null and empty texts have length 0 and are packed too; a document longer than the budget
is a batch of its own; repeated rows are packed once each; an empty table gives an empty result.
Every row of the input appears exactly once.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gleaner.llm.common import cut, keyed_hash, n_words


@dataclass(frozen=True)
class PackParams:
    buckets: int = 8
    batch_tokens: int = 65_536
    split_rows: int = 20_000  # rows that one task numbers at once
    key: str = "pack"


def _layer(best: np.ndarray, s: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each j the least ``best[i] + s[j - 1] * (n[j] - n[i])`` over i < j, and the i. The best i never falls
    as j grows, so the middle j of a range halves its candidates: all ranges of a depth are one pass of arrays."""
    m = len(s)
    now, prev = np.zeros(m + 1), np.zeros(m + 1, np.int64)
    lo, hi, first, last = (np.array([x], np.int64) for x in (1, m, 0, m - 1))
    while len(lo):
        mid = (lo + hi) >> 1
        size = np.minimum(last, mid - 1) - first + 1
        start = np.cumsum(size) - size
        i = np.arange(size.sum()) - np.repeat(start, size) + np.repeat(first, size)
        j = np.repeat(mid, size)
        cost = best[i] + s[j - 1] * (n[j] - n[i])
        least = np.minimum.reduceat(cost, start)
        at = np.flatnonzero(cost == np.repeat(least, size))
        best_i = i[at[np.searchsorted(at, start)]]  # the first of equal ones
        now[mid], prev[mid] = least, best_i
        lo, hi, first, last = (np.concatenate(x) for x in ((lo, mid + 1), (mid - 1, hi), (first, best_i), (best_i, last)))
        some = lo <= hi
        lo, hi, first, last = lo[some], hi[some], first[some], last[some]
    return now, prev


def boundaries(sizes, counts, buckets: int) -> list[int]:
    """Bucket boundaries (ascending, the last is the largest size) with the least total padding.

    ``sizes`` are distinct and ascending, ``counts`` the documents of each. Real tokens are the same for all
    boundaries, so the least padded total is the least padding."""
    if not len(sizes):
        return []
    s = np.asarray(sizes, dtype=np.float64)
    n = np.concatenate([[0.0], np.cumsum(np.asarray(counts, dtype=np.float64))])
    best = np.full(len(s) + 1, np.inf)
    best[0] = 0.0
    back = []
    for _ in range(min(buckets, len(s))):
        best, prev = _layer(best, s, n)
        back.append(prev)
    out, j = [], len(s)
    for prev in reversed(back):
        if j == 0:
            break
        out.append(int(sizes[j - 1]))
        j = int(prev[j])
    return sorted(set(out))


def histogram(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Distinct lengths, ascending, and the rows of each."""
    got = rows.groupBy("n_tokens").agg(F.count("*").alias("n")).toArrow()
    size, n = (got.column(c).to_numpy() for c in ("n_tokens", "n"))
    order = np.argsort(size)
    return size[order], n[order]


def pack(docs: DataFrame, length: Column | None = None, params: PackParams = PackParams()) -> DataFrame:
    """``doc_id, n_tokens, bucket, pad_to, batch, slot``: one row per row of ``docs``."""
    p = params
    length = n_words(F.col("text")) if length is None else length
    rows = cut(docs.select("doc_id", F.coalesce(length.cast("long"), F.lit(0)).alias("n_tokens")))
    sizes, counts = histogram(rows)
    ends = boundaries(sizes, counts, p.buckets) or [0]
    fits = F.array(*[F.lit(int(e)) for e in ends])
    bucket = F.size(F.filter(fits, lambda e: e < F.col("n_tokens")))
    parts = max(1, -(-int(counts.sum()) // p.split_rows))
    order = keyed_hash(p.key, F.col("doc_id"))
    rows = rows.select("*", bucket.alias("bucket"), order.alias("order")).withColumn("part", F.pmod(F.col("order"), F.lit(parts)))
    counts = rows.groupBy("bucket", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("bucket").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("bucket", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    inside = Window.partitionBy("bucket", "part").orderBy("order", "doc_id", "n_tokens")
    at = F.col("start") + F.row_number().over(inside) - 1
    rows = rows.join(offsets, ["bucket", "part"]).withColumn("at", at)
    pad = F.element_at(fits, F.col("bucket") + 1)
    each = F.greatest(F.lit(1), F.floor(F.lit(p.batch_tokens) / F.greatest(pad, F.lit(1))))
    return rows.select(
        "doc_id", "n_tokens", "bucket", pad.cast("long").alias("pad_to"),
        F.concat_ws("-", F.col("bucket"), F.floor(F.col("at") / each)).alias("batch"), (F.col("at") % each).cast("long").alias("slot"),
    )
