"""Nearest neighbours by inner product along shifted Hilbert curves.

1. Equal vectors become one point that carries its smallest ids; no answer needs more of them.
2. Points are projected (seeded, orthonormal) and ordered along several shifted Hilbert curves, each
   range-partitioned by Spark (equal keys are told apart by id, so no partition outgrows the others).
   Along each curve, every query point looks at the neighbouring windows; the rows next to a partition's
   border meet those beyond it in a second step. The curves' candidates merge and are reranked by their
   products in double precision, summed in order.
3. An exact check follows: partitions of the first curve, each with a centre and a radius, meet the queries
   that they may improve (``q.c + |q| r`` reaches the query's last score); so do, inside, the windows. What
   it finds joins the windows' candidates. With clustered vectors few partitions are read; with vectors
   without structure (64 independent components) most are, because no short list holds their neighbours
   and no curve brings them together. ``exact=False`` stops after step 2.

Only vectors of one length are compared with each other. Edge cases: vectors that are null, empty,
zero or hold null or non-finite components take no part, and rows with a null id neither; repeated
rows of an id are one; equal scores go to the smaller id at every cut; fewer than ``k`` candidates give
fewer rows; empty tables give an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gleaner.llm.common import cut
from gleaner.llm.vectors import matrix, packed, products


@dataclass(frozen=True)
class CurveParams:
    k: int = 20
    curves: int = 6
    dims: int = 6  # components of the projection
    bits: int = 10  # per component; dims * bits < 63
    window: int = 256  # rows on either side of a query's window
    block: int = 256  # rows of a window
    cell_rows: int = 4_096  # rows that a task holds
    query_rows: int = 4_096  # queries that meet a cell at once
    least_cells: int = 12
    ball_rows: int = 1_024  # partitions whose reach is tested at once
    seed: int = 17
    exact: bool = True


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """Position on the Hilbert curve of integer points ``cells`` (rows x dims)."""
    x = cells.astype(np.int64).T.copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        low = q - 1
        for i in range(n):
            on = (x[i] & q) != 0
            swap = np.where(on, 0, (x[0] ^ x[i]) & low)
            x[0] = np.where(on, x[0] ^ low, x[0] ^ swap)
            x[i] = x[i] ^ swap
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    flip, q = np.zeros_like(x[0]), 1 << (bits - 1)
    while q > 1:
        flip = np.where((x[n - 1] & q) != 0, flip ^ (q - 1), flip)
        q >>= 1
    x ^= flip
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def curve_keys(v: np.ndarray, p: CurveParams) -> np.ndarray:
    """Keys (rows x curves). Directions decide the order, so vectors are scaled to length 1."""
    d = v.shape[1]
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    keys = np.empty((len(v), p.curves), np.int64)
    for c in range(p.curves):
        rng = np.random.default_rng([p.seed, c, d])
        basis, _ = np.linalg.qr(rng.standard_normal((d, d)))
        m = min(p.dims, d)
        y = unit @ basis[:, :m] * np.sqrt(d) / 8 + 0.5 + rng.uniform(-0.1, 0.1, m)
        cells = np.clip((y * (1 << p.bits)).astype(np.int64), 0, (1 << p.bits) - 1)
        keys[:, c] = hilbert(cells, p.bits)
    return keys


def _best(score: np.ndarray, ids: np.ndarray, k: int, exact) -> np.ndarray:
    """Columns of the k best of each row (unordered). Products of matrices differ from sums in order by rounding,
    so where more than k may be among the best, ``exact(row, columns)`` gives their scores; of equal ones the
    smaller ids count."""
    if score.shape[1] <= k:
        return np.broadcast_to(np.arange(score.shape[1]), score.shape)
    top = np.argpartition(-score, k - 1, axis=1)[:, :k]
    least = np.take_along_axis(score, top, 1).min(1)
    least = np.where(np.isfinite(least), least - 1e-12 * (1 + np.abs(least)) * 64, least)
    for i in np.flatnonzero((score >= least[:, None]).sum(1) > k):
        at = np.flatnonzero(score[i] >= least[i])
        top[i] = at[np.lexsort((ids[i, at], -exact(i, at)))[:k]]
    return top


def _none() -> pd.DataFrame:
    return pd.DataFrame({"q": np.zeros(0, np.int64), "pt": np.zeros(0, np.int64), "score": np.zeros(0)})


def _windows(part: pd.DataFrame, p: CurveParams) -> pd.DataFrame:
    """A stretch of a curve: the k + 1 best of each query among the windows next to it."""
    out = []
    part = part.sort_values(["key", "pt"], kind="stable")
    v, pt, ask = matrix(part["v"]), part["pt"].to_numpy(), part["is_query"].to_numpy(bool)
    for s in range(0, len(v), p.block):
        q = np.flatnonzero(ask[s : s + p.block]) + s
        if len(q):
            a, b = max(0, s - p.window), min(len(v), s + p.block + p.window)
            score = v[q] @ v[a:b].T
            top = _best(score, np.broadcast_to(pt[a:b], score.shape), p.k + 1, lambda i, at, q=q, a=a: products(np.broadcast_to(v[q[i]], (len(at), v.shape[1])), v[a + at]))
            row = np.repeat(q, top.shape[1])
            to = a + top.ravel()
            out.append(pd.DataFrame({"q": pt[row], "pt": pt[to], "score": products(v[row], v[to])}))
    return pd.concat(out) if out else _none()


LINE = "q long, pt long, score double, d int, curve int, border int, key long, is_query boolean, v array<double>"


def _stretch(pdf: pd.DataFrame, cell: int, p: CurveParams) -> Iterator[pd.DataFrame]:
    """A partition: what its windows find, and the rows next to its two borders (border i is that before partition i)."""
    for (d, curve), part in pdf.groupby(["d", "curve"], sort=False):
        yield _windows(part, p).assign(d=None, curve=None, border=None, key=None, is_query=None, v=None)
        part = part.sort_values(["key", "pt"], kind="stable")
        for border, near in ((cell, part.head(p.block + p.window)), (cell + 1, part.tail(p.block + p.window))):
            yield near.assign(q=None, score=None, d=d, curve=curve, border=border)


def _ball(pdf: pd.DataFrame) -> pd.DataFrame:
    x = matrix(pdf["v"])
    c = x.mean(0)
    r = float(np.sqrt(((x - c) ** 2).sum(1).max()) * (1 + 1e-9))
    return pd.DataFrame({"d": [int(pdf["d"].iloc[0])], "cell": [int(pdf["cell"].iloc[0])], "c": [c.tolist()], "r": [r]})


def _low(bound: np.ndarray) -> np.ndarray:
    return np.where(np.isfinite(bound), bound - 1e-9 * (1 + np.abs(bound)), -np.inf)


def _reach(q: pd.DataFrame, balls: pd.DataFrame) -> pd.DataFrame:
    """Which of the queries a partition may give a better answer."""
    if not len(q) or not len(balls):
        return pd.DataFrame({"pt": np.zeros(0, np.int64), "cell": np.zeros(0, np.int64)})
    a = matrix(q["v"])
    most = a @ matrix(balls["c"]).T + np.linalg.norm(a, axis=1)[:, None] * balls["r"].to_numpy()[None]
    row, col = np.nonzero(most >= _low(q["bound"].to_numpy(np.float64))[:, None])
    return pd.DataFrame({"pt": q["pt"].to_numpy()[row], "cell": balls["cell"].to_numpy()[col]})


def _cell(q: pd.DataFrame, x: pd.DataFrame, p: CurveParams) -> pd.DataFrame:
    """A partition's points for the queries that it may improve: what may belong to the k + 1 best points."""
    if not len(q) or not len(x):
        return _none()
    x = x.sort_values(["key", "pt"], kind="stable")
    a, qid, bound = matrix(q["v"]), q["pt"].to_numpy(), q["bound"].to_numpy(np.float64)
    v, pt = matrix(x["v"]), x["pt"].to_numpy()
    length = np.linalg.norm(a, axis=1)
    got_s = np.full((len(a), p.k + 1), -np.inf)
    got_at = np.full((len(a), p.k + 1), -1, np.int64)
    for s in range(0, len(v), p.block):
        w = v[s : s + p.block]
        c = w.mean(0)
        r = np.sqrt(((w - c) ** 2).sum(1).max()) * (1 + 1e-9)
        reach = np.flatnonzero(a @ c + length * r >= _low(bound))
        if not len(reach):
            continue
        score = np.concatenate([got_s[reach], a[reach] @ w.T], axis=1)
        at = np.concatenate([got_at[reach], np.broadcast_to(np.arange(s, s + len(w)), (len(reach), len(w)))], axis=1)
        ids = np.where(at >= 0, pt[at], -1)

        def exact(i: int, cols: np.ndarray, at: np.ndarray = at, reach: np.ndarray = reach) -> np.ndarray:
            to = at[i, cols]
            return np.where(to >= 0, products(np.broadcast_to(a[reach[i]], (len(to), a.shape[1])), v[to]), -np.inf)

        top = _best(score, ids, p.k + 1, exact)
        got_s[reach], got_at[reach] = np.take_along_axis(score, top, 1), np.take_along_axis(at, top, 1)
        bound[reach] = np.maximum(bound[reach], got_s[reach].min(1))
    row, col = np.nonzero((got_at >= 0) & (got_s >= _low(bound)[:, None]))
    to = got_at[row, col]
    return pd.DataFrame({"q": qid[row], "pt": pt[to], "score": products(a[row], v[to])})


FOUND = "q long, pt long, score double"
LINE_COLUMNS = [c.split()[0] for c in LINE.split(", ")]


def _top(found: DataFrame, n: int) -> DataFrame:
    best = Window.partitionBy("q").orderBy(F.desc("score"), "pt")
    return found.withColumn("place", F.row_number().over(best)).where(F.col("place") <= n).drop("place")


def search(vectors: DataFrame, is_query, params: CurveParams = CurveParams()) -> DataFrame:
    """``query_id, rank, vec_id, score`` of ``vectors(vec_id, embedding)``; ``is_query`` is a condition on vec_id."""
    p = params
    rows = packed(vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").where("vec_id IS NOT NULL"))
    rows = rows.select("vec_id", "v", is_query.alias("is_query"), F.pmod(F.xxhash64("vec_id"), F.lit(64)).alias("salt")).distinct()
    # A point: equal vectors, named by their smallest id, with the k + 1 smallest ids in order.
    few = lambda by: Window.partitionBy(*by).orderBy("vec_id")
    least = rows.withColumn("n", F.row_number().over(few(["v", "salt"]))).where(F.col("n") <= p.k + 1)
    least = least.withColumn("n", F.row_number().over(few(["v"]))).where(F.col("n") <= p.k + 1)
    points = least.groupBy("v").agg(F.min("vec_id").alias("pt"), F.sort_array(F.collect_list("vec_id")).alias("ids"))
    asking = rows.where("is_query").groupBy("v").agg(F.lit(True).alias("asks"))

    def keyed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for d, part in pdf.groupby(pdf["v"].map(len), sort=False):
                keys = curve_keys(matrix(part["v"]), p)
                yield part.assign(d=d, keys=list(keys))

    points = points.join(asking, "v", "left").select("pt", "v", "ids", F.coalesce("asks", F.lit(False)).alias("is_query"))
    points = cut(points.mapInPandas(keyed, "pt long, v array<double>, ids array<long>, is_query boolean, d int, keys array<long>"))
    n = points.count()
    cells = max(p.least_cells, -(-n // p.cell_rows))

    # Step 2: windows along every curve, then across the borders of partitions.
    line = points.select("pt", "v", "is_query", "d", F.posexplode("keys").alias("curve", "key"))
    line = line.repartitionByRange(cells, "d", "curve", "key", "pt")

    def stretches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = list(batches)  # a partition: some ``cell_rows`` points, or curves as many
        if held:
            for found in _stretch(pd.concat(held), TaskContext.get().partitionId(), p):
                yield found[LINE_COLUMNS]

    line = cut(line.mapInPandas(stretches, LINE))
    edges = line.where("border IS NOT NULL").groupBy("d", "curve", "border").applyInPandas(lambda pdf: _windows(pdf, p), FOUND)
    near = line.where("border IS NULL").select("q", "pt", "score").unionByName(edges)
    near = cut(_top(near.groupBy("q", "pt").agg(F.max("score").alias("score")), p.k + 1))

    found = near
    if p.exact:
        # Step 3: partitions of the first curve against tiles of the queries that they may improve.
        last = near.groupBy("q").agg(F.min("score").alias("low"), F.count("*").alias("n"))
        asks = points.where("is_query").select("pt", "v", "d").join(last, F.col("pt") == F.col("q"), "left")
        tiles = max(1, -(-points.where("is_query").count() // p.query_rows))
        tile = F.pmod(F.xxhash64("pt"), F.lit(tiles)).cast("int").alias("tile")
        asks = cut(asks.select("pt", "v", "d", F.when(F.col("n") > p.k, F.col("low")).otherwise(F.lit(float("-inf"))).alias("bound"), tile))
        ranged = points.select("pt", "v", "d", F.get("keys", 0).alias("key")).repartitionByRange(cells, "d", "key", "pt")
        ranged = cut(ranged.withColumn("cell", F.spark_partition_id()))
        several = lambda n, name: F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias(name)
        sheets = -(-cells // p.ball_rows)
        balls = ranged.groupBy("d", "cell").applyInPandas(_ball, "d int, cell int, c array<double>, r double")
        balls = balls.select("*", F.floor(F.col("cell") / p.ball_rows).cast("int").alias("sheet"), several(tiles, "tile"))
        by = ["tile", "sheet", "d"]
        met = asks.select("*", several(sheets, "sheet")).groupBy(*by).cogroup(balls.groupBy(*by)).applyInPandas(_reach, "pt long, cell int")
        met = cut(met.join(asks.select("pt", "tile", "d"), "pt"))
        x = ranged.join(met.select("cell", "tile", "d").distinct(), ["cell", "d"]).select("pt", "v", "key", *[F.col(c).alias(c) for c in ("cell", "tile", "d")])
        q = met.join(asks.select("pt", "v", "bound"), "pt")
        by = ["cell", "tile", "d"]
        more = q.groupBy(*by).cogroup(x.groupBy(*by)).applyInPandas(lambda a, b: _cell(a, b, p), FOUND)
        found = near.unionByName(more).groupBy("q", "pt").agg(F.max("score").alias("score"))
    near = _top(found, p.k + 1).join(points.select("pt", "ids"), "pt")
    lists = near.groupBy("q").agg(F.collect_list(F.struct("score", "ids")).alias("near"))  # k + 1 entries at most
    each = F.transform(F.col("near"), lambda e: F.transform(e["ids"], lambda i: F.struct((-e["score"]).alias("s"), i.alias("vec_id"))))
    lists = lists.select("q", F.array_sort(F.flatten(each)).alias("near"))
    queries = rows.where("is_query").select("vec_id", "v").join(points.select("v", F.col("pt").alias("q")), "v").select("vec_id", "q")
    own = F.filter(F.col("near"), lambda e: e["vec_id"] != F.col("vec_id"))
    out = queries.join(lists, "q").select(F.col("vec_id").alias("query_id"), F.posexplode(F.slice(own, 1, p.k)).alias("at", "e"))
    return out.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("e.vec_id").alias("vec_id"), (-F.col("e.s")).alias("score"))


def oracle(k: int = 20, every: int = 20) -> str:
    """Full search in DuckDB SQL."""
    return f"""WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE embedding IS NOT NULL
  AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
s AS (SELECT q.vec_id AS query_id, x.vec_id, list_inner_product(q.v, x.v) AS score FROM v q JOIN v x ON q.vec_id % {every} = 0 AND q.vec_id <> x.vec_id AND len(q.v) = len(x.v)),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= {k}"""
