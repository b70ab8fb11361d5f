"""Quality scores from a byte-level convolutional network in numpy.

A document is cut into overlapping chunks of bytes that cover all of it. A byte's symbol also says
whether it begins four bytes that stood up to ``recall`` bytes before, so that filters, which are
linear, can see repetition. Filters over embedded symbols slide along each chunk; the largest response of each filter is the chunk's feature. A document's
features are the largest responses over its chunks; a logistic unit turns them into a probability.

The network is trained on the driver with Adam, on whole texts of at most ``sample`` documents of each
label. That bound on labelled rows holds for training only.

Edge cases: null and empty texts are one empty chunk and are scored too; rows with a null doc_id are
scored and not held out; repeated rows score alike; without rows of both labels the score is the share
of label 1, or 0.5 without labels; an empty table gives an empty result. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.llm import rolling


@dataclass(frozen=True)
class NetParams:
    sample: int = 1_500  # training documents of each label
    chunk: int = 512
    overlap: int = 64
    width: int = 8
    stride: int = 4
    depth: int = 8
    filters: int = 16
    recall: int = 32
    epochs: int = 8
    steps: int = 500  # at least so many batches, however few the texts
    lean: float = 3.0  # weight of label 1, of which there are more than the balanced sample shows
    short: float = 0.3  # share of label-1 texts that train as a short piece: short isn't bad
    batch: int = 32
    rate: float = 0.01
    keep_at: float = 0.7
    seed: int = 5


#: Bytes whose chunks are in memory at once.
SLICE = 1 << 20


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def chunks(buf: np.ndarray, offsets: np.ndarray, p: NetParams) -> tuple[np.ndarray, np.ndarray]:
    """(chunks x bytes, document of each chunk); a document has one chunk or more. 0 pads."""
    size = np.diff(offsets)
    step = p.chunk - p.overlap
    count = np.maximum(1, -(-(size - p.overlap) // step))
    doc = np.repeat(np.arange(len(size)), count)
    start = (np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)) * step
    padded = np.concatenate([buf, np.zeros(p.chunk, np.uint8)])
    x = padded[(offsets[:-1][doc] + start)[:, None] + np.arange(p.chunk)]
    x[np.arange(p.chunk) >= (size[doc] - start)[:, None]] = 0
    return symbols(x, p), doc


def symbols(x: np.ndarray, p: NetParams) -> np.ndarray:
    """Bytes, plus 256 where the four bytes from here also stood a little before (padding excepted)."""
    four = x.astype(np.uint32)
    gram = four.copy()
    for k in (1, 2, 3):
        gram[:, :-k] |= four[:, k:] << np.uint32(8 * k)
    again = np.zeros(x.shape, bool)
    for d in range(1, p.recall + 1):
        again[:, d:] |= gram[:, d:] == gram[:, :-d]
    return x.astype(np.uint16) + np.where(again & (x > 0), np.uint16(256), np.uint16(0))


def _positions(p: NetParams) -> np.ndarray:
    return np.arange(0, p.chunk - p.width + 1, p.stride)


def responses(x: np.ndarray, net: dict[str, np.ndarray], p: NetParams) -> np.ndarray:
    """Features of chunks, by one table per place in the filter: no embedding at run time."""
    at = _positions(p)
    out = np.empty((len(x), p.filters), np.float32)
    for k in range(0, len(x), 64):
        part = x[k : k + 64]
        y = net["table"][0][part[:, at]]
        for w in range(1, p.width):
            y += net["table"][w][part[:, at + w]]
        out[k : k + 64] = y.max(1)
    return np.maximum(out + net["b"], 0)


def pooled(z: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    return np.maximum.reduceat(z, np.searchsorted(doc, np.arange(n)))


def scores(buf: np.ndarray, offsets: np.ndarray, net: dict[str, np.ndarray], p: NetParams) -> np.ndarray:
    n = len(offsets) - 1
    if "share" in net:
        return np.full(n, float(net["share"]))
    step = p.chunk - p.overlap
    z = np.full((n, p.filters), -np.inf)
    for i, j in rolling.groups_of(offsets, SLICE):  # a text over SLICE is a group of its own and is read slice by slice
        for a in range(0, max(1, int(offsets[j] - offsets[i]) - p.overlap), SLICE // step * step) if j == i + 1 else (0,):
            part = offsets[i : j + 1] - offsets[i]
            if j == i + 1:
                part = np.array([0, min(part[1] - a, SLICE // step * step + p.overlap)])
            at = offsets[i] + a
            x, doc = chunks(buf[at : at + part[-1]], part, p)
            z[i:j] = np.maximum(z[i:j], pooled(responses(x, net, p), doc, j - i))
    u = z @ net["v"].astype(np.float64) + float(net["c"])
    return 1 / (1 + np.exp(-np.clip(u, -30, 30)))


def train(texts: list[bytes], labels: np.ndarray, p: NetParams) -> dict[str, np.ndarray]:
    """Weights from texts (each a training piece list joined) and 0/1 labels."""
    if len(set(labels.tolist())) < 2:
        return {"share": np.float64(labels.mean() if len(labels) else 0.5)}
    rng = np.random.default_rng(p.seed)
    f, d, w = p.filters, p.depth, p.width
    net = {
        "e": rng.normal(0, 0.5, (512, d)), "k": rng.normal(0, (2 / (d * w)) ** 0.5, (w, d, f)),
        "b": np.zeros(f), "v": rng.normal(0, 0.3, f), "c": np.zeros(()),
    }
    net = {n: v.astype(np.float32) for n, v in net.items()}
    net["e"][0] = 0
    at = _positions(p)
    mean, square = ({n: np.zeros_like(v) for n, v in net.items()} for _ in range(2))
    texts = list(texts)
    for i in np.flatnonzero((labels == 1) & (rng.random(len(labels)) < p.short)):
        n = int(rng.integers(8, 200))
        at_ = int(rng.integers(0, max(1, len(texts[i]) - n)))
        texts[i] = texts[i][at_ : at_ + n]
    ones = float((labels == 1).mean())  # whatever the sample's shares, labels weigh lean : 1
    weight = np.where(labels == 1, p.lean / ones, 1 / (1 - ones)) / (1 + p.lean)
    data = [chunks(np.frombuffer(t, np.uint8), np.array([0, len(t)]), p)[0] for t in texts]
    t = 0
    epochs = max(p.epochs, -(-p.steps * p.batch // len(data)))
    for epoch in range(epochs):
        order = rng.permutation(len(data))
        for s in range(0, len(order), p.batch):
            ids = order[s : s + p.batch]
            x = np.concatenate([data[i] for i in ids])
            doc = np.repeat(np.arange(len(ids)), [len(data[i]) for i in ids])
            table = np.einsum("bd,wdf->wbf", net["e"], net["k"])
            y = table[0][x[:, at]]
            for i in range(1, w):
                y += table[i][x[:, at + i]]
            best = y.argmax(1)
            z = np.maximum(np.take_along_axis(y, best[:, None], 1)[:, 0] + net["b"], 0)
            h = pooled(z, doc, len(ids))
            prob = 1 / (1 + np.exp(-np.clip(h @ net["v"] + net["c"], -30, 30)))
            gu = ((prob - labels[ids]) * weight[ids] / len(ids)).astype(np.float32)
            grad = {"v": h.T @ gu, "c": gu.sum()}
            gh = gu[:, None] * net["v"]
            top = h[doc] == z  # the chunk with the largest response (the first of equals shares)
            share = np.add.reduceat(top.astype(np.float32), np.searchsorted(doc, np.arange(len(ids))))
            gz = gh[doc] * top / share[doc]
            gz = (gz * (z > 0)).astype(np.float32)
            grad["b"] = gz.sum(0)
            place = at[best]  # chunks x filters
            grad["k"], grad["e"] = np.zeros_like(net["k"]), np.zeros_like(net["e"])
            for i in range(w):
                byte = np.take_along_axis(x, place + i, 1)
                grad["k"][i] = np.einsum("nfd,nf->df", net["e"][byte], gz)
                np.add.at(grad["e"], byte.ravel(), (gz[:, :, None] * net["k"][i].T[None]).reshape(-1, d))
            grad["e"][0] = 0
            t += 1
            rate = p.rate * (0.3 if epoch >= epochs * 2 // 3 else 1)
            for n, g in grad.items():
                mean[n] = 0.9 * mean[n] + 0.1 * g
                square[n] = 0.999 * square[n] + 0.001 * g * g
                net[n] = net[n] - (rate * (mean[n] / (1 - 0.9**t)) / (np.sqrt(square[n] / (1 - 0.999**t)) + 1e-8)).astype(np.float32)
    net["table"] = np.einsum("bd,wdf->wbf", net["e"], net["k"]).astype(np.float32)
    return net


def fit(docs: DataFrame, labels: DataFrame, params: NetParams = NetParams()) -> dict[str, np.ndarray]:
    """Train on rows of ``labels`` that aren't held out."""
    p = params
    known = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.select("doc_id", F.col("quality").cast("int").alias("quality")).where("quality IN (0, 1)").distinct()
    order = F.md5(F.concat(F.lit(f"{p.seed}/"), F.col("doc_id").cast("string")))
    chosen = None
    for q in (0, 1):
        part = known.where(F.col("quality") == q).orderBy(order, "doc_id").limit(p.sample)
        chosen = part if chosen is None else chosen.unionByName(part)
    rows = docs.where("text IS NOT NULL").join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "quality")
    rows = rows.groupBy("doc_id", "quality").agg(F.min("text").alias("text"))  # 2 * sample rows at most, however often an id repeats
    rows = sorted((r["doc_id"], r["text"], r["quality"]) for r in rows.collect())
    return train([r[1].encode() for r in rows], np.array([r[2] for r in rows], np.float32), p)


def score(docs: DataFrame, net: dict[str, np.ndarray], params: NetParams = NetParams(), name: str = "quality_score") -> DataFrame:
    """All columns of ``docs`` with the score as ``name`` (which ``docs`` mustn't have, see ``common.unused``); whole texts are read."""
    p = params
    small = {n: net[n] for n in ("table", "b", "v", "c", "share") if n in net}
    place = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, at = rolling.buffers(batch.column(place))
            got = [scores(buf[at[i] : at[j]], at[i : j + 1] - at[i], small, p) for i, j in rolling.groups_of(at, 1_000_000)]
            out = np.round(np.concatenate(got), 6) if got else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.float64())], names=[*batch.schema.names, name])

    schema = docs.select("*", F.lit(0.0).alias(name)).schema
    return docs.mapInArrow(run, schema)


def judge(docs: DataFrame, labels: DataFrame, params: NetParams = NetParams()) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row of ``docs``."""
    net = fit(docs, labels, params)
    got = score(docs.select("doc_id", "text"), net, params)
    s = F.col("quality_score")
    return got.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), s.alias("score"), F.when(s >= params.keep_at, 1).otherwise(0).alias("predicted"))
