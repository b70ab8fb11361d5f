"""Near-duplicate vectors by products of int8 tiles.

Vectors of a label are scaled to length 1 and quantised to int8 with one scale per vector; the length
of each vector's rounding error is kept. For two vectors

    |x.y - sx sy qx.qy| <= |x^| |ey| + |ex| |y^| + |ex| |ey|

so a pair whose quantised product plus this bound stays under the threshold can't link. Tiles of a
label meet tile by tile; the integer products run as float32 matrix products, which are exact here
(127 * 127 * dims < 2**24). Only pairs that may reach the threshold are recomputed in double precision.

Points of a label are ordered along a Hilbert curve of projected directions and dealt into tiles by range,
so a tile of clustered vectors has a small radius around its centre, and tile pairs whose centres are too
far apart never meet. Two steps do the rest. First, int8 values travel (an eighth of the bytes): a tile pair
tells which of its vectors have a partner that may link. Then only those vectors travel in double precision,
and the pair is recomputed. A tile pair gives, per vector, its number of links, and a spanning forest of the
links it found, never the pairs.

Equal vectors are one point with a count. Edge cases: vectors that are null, empty, zero or hold null or
non-finite components, and those with a null label or id, link with nothing; vectors of different length
aren't compared; repeated rows of an id are one vector; every row gives one row.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm.ann import CurveParams, curve_keys
from gleaner.llm.common import cut
from gleaner.llm.components import components
from gleaner.llm.vectors import matrix, usable


@dataclass(frozen=True)
class TileParams:
    threshold: float = 0.93
    tile: int = 2_048  # vectors of a tile
    rows: int = 256  # rows of a tile compared at once
    least_tiles: int = 8
    curve: CurveParams = CurveParams(curves=1)


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(int8 values, scale, length of the quantised vector, length of the error) of unit rows."""
    scale = np.abs(x).max(1) / 127
    q = np.rint(x / scale[:, None]).astype(np.int8)
    back = q.astype(np.float64) * scale[:, None]
    up = 1 + 1e-12
    return q, scale, np.linalg.norm(back, axis=1) * up, np.linalg.norm(x - back, axis=1) * up


def _unit(x: np.ndarray) -> np.ndarray:
    top = np.abs(x).max(1, keepdims=True)  # first by the largest component: squares may overflow
    y = x / top
    return y / np.sqrt((y * y).sum(1, keepdims=True))


def _exact_limit(dims: int) -> int:
    """Components whose products float32 adds exactly."""
    return max(1, min(dims, (1 << 24) // (127 * 127) - 1))


def _may(qx, sx, nx, ex, qy, sy, ny, ey, p: TileParams) -> np.ndarray:
    """Which pairs of quantised rows may reach the threshold."""
    step = _exact_limit(qx.shape[1])
    dot = np.zeros((len(qx), len(qy)))
    for d in range(0, qx.shape[1], step):
        dot += qx[:, d : d + step].astype(np.float32) @ qy[:, d : d + step].astype(np.float32).T
    bound = nx[:, None] * ey[None] + ex[:, None] * ny[None] + ex[:, None] * ey[None]
    return dot * sx[:, None] * sy[None] + bound >= p.threshold - 1e-9


def tile_links(x: np.ndarray, y: np.ndarray | None, p: TileParams):
    """Yields (i, j) index arrays of linked pairs of x and y (of x alone, i < j, if y is None), block by block."""
    same = y is None
    y = x if same else y
    if not len(x) or not len(y):
        return
    qx = quantise(x)
    qy = qx if same else quantise(y)
    for s in range(0, len(x), p.rows):
        r = slice(s, s + p.rows)
        may = _may(*[c[r] for c in qx], *qy, p)
        if same:
            may &= np.arange(len(y))[None] > (np.arange(len(may)) + s)[:, None]
        i, j = np.nonzero(may)
        if len(i) * 20 > may.size:  # many may link: one product of the block in double precision
            ok = (x[r] @ y.T)[i, j] >= p.threshold
        else:
            ok = np.concatenate([(x[s + i[k : k + 65_536]] * y[j[k : k + 65_536]]).sum(1) for k in range(0, len(i), 65_536)] or [np.zeros(0)]) >= p.threshold
        yield i[ok] + s, j[ok]


def _candidates(pdf: pd.DataFrame, p: TileParams) -> pd.DataFrame:
    """The points of a pair of tiles that have a partner which may link, from their int8 values."""
    first = pdf["side"].to_numpy() == 0
    two = int(pdf["i"].iloc[0]) != int(pdf["j"].iloc[0])
    q = np.frombuffer(b"".join(pdf["q"]), np.int8).reshape(len(pdf), -1)
    about = [pdf[c].to_numpy() for c in ("scale", "size", "err")]
    x, y = ([q[on], *[c[on] for c in about]] for on in (first, ~first if two else first))
    hit_x, hit_y = np.zeros(len(x[0]), bool), np.zeros(len(y[0]), bool)
    for s in range(0, len(hit_x), p.rows):
        may = _may(*[c[s : s + p.rows] for c in x], *y, p)
        if not two:
            may &= np.arange(len(hit_y))[None] != (np.arange(len(may)) + s)[:, None]
        hit_x[s : s + p.rows] |= may.any(1)
        hit_y |= may.any(0)
    hit = np.zeros(len(pdf), bool)
    hit[first] = hit_x if two else hit_x | hit_y
    if two:
        hit[~first] = hit_y
    return pdf.loc[hit, ["label", "d", "i", "j", "side", "pt"]]


def _tile(pdf: pd.DataFrame, p: TileParams) -> pd.DataFrame:
    """A pair of tiles: rows (a, b) of a spanning forest with negative n, and (a, a, n) with numbers of links."""
    out_a, out_b, out_n = [], [], []
    pdf = pdf.sort_values(["side", "pt"], kind="stable")
    unit, pt, weight = _unit(matrix(pdf["v"])), pdf["pt"].to_numpy(), pdf["n"].to_numpy()
    n0 = int((pdf["side"] == 0).sum())
    two = int(pdf["i"].iloc[0]) != int(pdf["j"].iloc[0])  # by the tiles, not by the rows that are left
    links, up = np.zeros(len(unit), np.int64), np.arange(len(unit))

    def root(k: int) -> int:
        while up[k] != k:
            up[k] = up[up[k]]
            k = up[k]
        return k

    for i, j in tile_links(unit[:n0], unit[n0:] if two else None, p):
        j = j + n0 if two else j
        np.add.at(links, i, weight[j])
        np.add.at(links, j, weight[i])
        while len(i):  # pairs whose ends are in one tree already go at once
            near = np.fromiter((root(k) for k in range(len(up))), np.int64, len(up))
            new = near[i] != near[j]
            i, j = i[new], j[new]
            _, first = np.unique(near[i], return_index=True)
            for a, b in zip(i[first].tolist(), j[first].tolist(), strict=True):
                ra, rb = root(a), root(b)
                if ra != rb:
                    up[max(ra, rb)] = min(ra, rb)
                    out_a.append(pt[a])
                    out_b.append(pt[b])
                    out_n.append(-1)
    some = np.flatnonzero(links)
    out_a.extend(pt[some])
    out_b.extend(pt[some])
    out_n.extend(links[some])
    return pd.DataFrame({"a": np.array(out_a, np.int64), "b": np.array(out_b, np.int64), "n": np.array(out_n, np.int64)})


def _quantised(batches: Iterator[pd.DataFrame], p: TileParams) -> Iterator[pd.DataFrame]:
    """Points with their place along the curve, the unit vector's int8 values and their error."""
    for pdf in batches:
        for d, part in pdf.groupby(pdf["v"].map(len), sort=False):
            unit = _unit(matrix(part["v"]))
            q, scale, size, err = quantise(unit)
            key = curve_keys(unit, p.curve)[:, 0]
            yield part.assign(d=d, key=key, q=[x.tobytes() for x in q], scale=scale, size=size, err=err)


def _balls(pdf: pd.DataFrame) -> pd.DataFrame:
    """Centre and radius of a tile's quantised vectors (their errors included)."""
    x = np.frombuffer(b"".join(pdf["q"]), np.int8).reshape(len(pdf), -1) * pdf["scale"].to_numpy()[:, None]
    c = x.mean(0)
    r = (np.sqrt(((x - c) ** 2).sum(1)) + pdf["err"].to_numpy()).max() * (1 + 1e-9)
    first = pdf.iloc[0]
    return pd.DataFrame({"label": [first["label"]], "d": [int(first["d"])], "tile": [int(first["tile"])], "c": [c.tolist()], "r": [float(r)]})


def near_duplicates(vectors: DataFrame, params: TileParams = TileParams()) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for every row of ``vectors(vec_id, embedding, label)``."""
    p = params
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", "label")
    kind = dict(rows.dtypes)["label"]
    ok = usable(F.col("embedding")) & F.col("label").isNotNull() & F.col("vec_id").isNotNull()
    good = rows.where(ok).select("vec_id", "label", F.col("embedding").cast("array<double>").alias("v")).distinct()
    points = good.groupBy("label", "v").agg(F.min("vec_id").alias("pt"), F.count("*").alias("n"))
    points = cut(points.mapInPandas(lambda it: _quantised(it, p), f"label {kind}, v array<double>, pt long, n long, d int, key long, q binary, scale double, size double, err double"))

    # Tiles: ranges of the curve within a label; equal keys are told apart by id, so no tile outgrows the others.
    small = points.select("label", "d", "key", "pt", "q", "scale", "size", "err")
    tiles = max(p.least_tiles, -(-points.count() // p.tile))
    small = cut(small.repartitionByRange(tiles, "label", "d", "key", "pt").withColumn("tile", F.spark_partition_id()))
    balls = cut(small.groupBy("label", "d", "tile").applyInPandas(_balls, f"label {kind}, d int, tile int, c array<double>, r double"))
    other = balls.select("label", "d", F.col("tile").alias("j"), F.col("c").alias("cj"), F.col("r").alias("rj"))
    # Unit vectors with a product of t are sqrt(2 - 2t) apart.
    apart = F.sqrt(F.aggregate(F.zip_with("c", "cj", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda a, x: a + x))
    near = apart <= F.col("r") + F.col("rj") + F.lit((2 - 2 * p.threshold) ** 0.5 * (1 + 1e-9))
    pairs = cut(balls.withColumnRenamed("tile", "i").join(other, ["label", "d"]).where((F.col("i") <= F.col("j")) & near).select("label", "d", "i", "j"))

    side = lambda tile, n: small.withColumnRenamed("tile", tile).join(pairs if n == 0 else pairs.where("i < j"), ["label", "d", tile]).select("label", "d", "i", "j", F.lit(n).alias("side"), "pt", "q", "scale", "size", "err")
    by = ["label", "d", "i", "j"]
    may = cut(side("i", 0).unionByName(side("j", 1)).groupBy(*by).applyInPandas(lambda pdf: _candidates(pdf, p), f"label {kind}, d int, i int, j int, side int, pt long"))
    full = may.join(points.select("pt", "n", "v"), "pt")
    found = cut(full.groupBy(*by).applyInPandas(lambda pdf: _tile(pdf, p), "a long, b long, n long"))
    comps = components(found.where("n < 0").select("a", "b"))
    counts = found.where("n > 0").groupBy("a").agg(F.sum("n").alias("links"))
    result = points.join(counts, F.col("pt") == F.col("a"), "left").join(comps, F.col("pt") == F.col("node"), "left")
    result = result.select("label", "v", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("links"), F.coalesce("component", "pt").alias("component"))
    ids = good.join(result, ["label", "v"]).groupBy("vec_id").agg(F.max("links").alias("links"), F.min("component").alias("component"))
    out = rows.select("vec_id").join(ids, "vec_id", "left")
    comp = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), comp.alias("component_id"), F.col("vec_id").eqNullSafe(comp).alias("kept"))


def oracle(threshold: float = 0.93) -> str:
    """All pairs of a label and their components in DuckDB SQL."""
    return f"""WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
  AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
e AS (SELECT x.vec_id AS a, y.vec_id AS b FROM v x JOIN v y ON x.label = y.label AND x.vec_id <> y.vec_id AND len(x.v) = len(y.v) AND list_cosine_similarity(x.v, y.v) >= {threshold}),
r AS (SELECT vec_id AS v, vec_id AS c FROM embeddings UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.v),
k AS (SELECT v, min(c) AS c FROM r GROUP BY 1), n AS (SELECT a, count(*) AS n FROM e GROUP BY 1)
SELECT d.vec_id, coalesce(n.n, 0) AS n_links, k.c AS component_id, d.vec_id = k.c AS kept FROM embeddings d JOIN k ON k.v = d.vec_id LEFT JOIN n ON n.a = d.vec_id"""
