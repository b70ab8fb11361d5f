"""Best documents of many queries at once: scores of a few hundred documents are one table in a task, which keeps
each query's best so far; only those leave it."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from gleaner.operators.words import lean

CHUNK = 512  # documents scored together
Variant = tuple  # ("tfidf_raw",), ("tfidf_log",) or ("bm25", k1, b)


@dataclass
class Asked:
    """The queries of one treatment. Entries ``starts[i]:starts[i + 1]`` are the queries that hold term ``i``: their
    ``slot`` from ``first`` on, and the query's factor for each kind of ranker."""

    first: int
    n_slots: int
    starts: np.ndarray
    slot: np.ndarray
    factors: dict[str, np.ndarray]
    avgdl: float


def rounded(scores: np.ndarray) -> np.ndarray:
    """Nine places, as whole numbers: scores that differ by rounding only tie."""
    return np.floor(scores * 1e9 + 0.5)


class Best:
    """The ``top`` best documents of each run, by score and then document order."""

    def __init__(self, runs: int, top: int):
        self.top, self.size = top, top + CHUNK
        self.scores, self.docs = np.empty((runs, self.size)), np.empty((runs, self.size), np.int64)
        self.n, self.least = np.zeros(runs, np.int64), np.zeros(runs)

    def add(self, run: int, scores: np.ndarray, docs: np.ndarray) -> None:
        """CHUNK scores at most; those that can't be among the best are left out before."""
        n, m = self.n[run], len(scores)
        if n + m > self.size:
            self.cut(run)
            n = self.n[run]
        self.scores[run, n : n + m], self.docs[run, n : n + m] = scores, docs
        self.n[run] = n + m

    def cut(self, run: int) -> tuple[np.ndarray, np.ndarray]:
        n = self.n[run]
        s, d = self.scores[run, :n], self.docs[run, :n]
        order = np.lexsort((d, -rounded(s)))[: self.top]
        s, d = s[order], d[order]
        self.scores[run, : len(s)], self.docs[run, : len(s)], self.n[run] = s, d, len(s)
        if len(s) == self.top:
            self.least[run] = max(0.0, (rounded(s[-1:])[0] - 0.5) * 1e-9 * (1 - 1e-9) - 1e-12)  # a little less, as equals may come
        return s, d


def packed(x: np.ndarray) -> bytes:
    """64-bit numbers, their first bytes together, then their second ones: those that hardly vary shrink to nothing."""
    return zlib.compress(np.ascontiguousarray(x.view(np.uint8).reshape(len(x), 8).T).tobytes(), 1)


def unpacked(data: bytes, kind: type) -> np.ndarray:
    planes = np.frombuffer(zlib.decompress(data), np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).reshape(-1).view(kind)


def document_factor(variant: Variant, tf: np.ndarray, row: np.ndarray, rows: dict[str, np.ndarray], avgdl: float) -> np.ndarray:
    if variant[0] == "bm25":
        _, k1, b = variant
        return tf * (k1 + 1) / (tf + (k1 * ((1 - b) + b * rows["doc_len"] / avgdl))[row])
    return (tf if variant[0] == "tfidf_raw" else 1.0 + np.log10(tf)) / rows["norm" + variant[0].removeprefix("tfidf")][row]


def best(matches: DataFrame, asked: dict[str, Asked], variants: list[Variant], top: int, tasks: int, ranks_only: bool = False, first: Callable | None = None, normed: bool = False) -> DataFrame:
    """``run, rank, doc_idx, score`` of the ``top`` best documents with a positive score; the run of a slot and a variant is
    ``slot * len(variants) + variant``. ``matches`` is as in ``words.matches``, with ``norm_raw, norm_log`` if ``normed``. A task sends ``top`` documents of each run at most, and there are ``tasks`` of them, so what crosses the
    network doesn't grow with the documents. With ``ranks_only`` scores come back in nine places, which take half the room.
    ``first`` makes batches like those of ``matches`` from its own in the same worker."""
    v = len(variants)
    runs = sum(a.n_slots for a in asked.values()) * v
    columns = ["doc_len", *(["norm_raw", "norm_log"] if normed else [])]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = Best(runs, top)
        for b in first(batches) if first else batches:
            for t, a in asked.items():
                own = b.filter(pc.equal(b["treatment"], t))
                for at in range(0, own.num_rows, CHUNK):
                    part = own.slice(at, CHUNK)
                    size, docs = part.num_rows, part["doc_idx"].to_numpy()
                    rows = {c: part[c].to_numpy(zero_copy_only=False).astype(np.float64) for c in columns}
                    ids, tf = part["ids"].flatten().to_numpy(), part["tfs"].flatten().to_numpy().astype(np.float64)
                    row = np.repeat(np.arange(size), pc.list_value_length(part["ids"]).to_numpy())
                    n = a.starts[ids + 1] - a.starts[ids]
                    pair = np.repeat(np.arange(len(ids)), n)
                    entry = np.arange(len(pair)) + np.repeat(a.starts[ids] - (np.cumsum(n) - n), n)
                    cell = a.slot[entry] * size + row[pair]
                    factors = {k: f[entry] for k, f in a.factors.items()}
                    for i, variant in enumerate(variants):
                        weights = factors[variant[0]] * document_factor(variant, tf, row, rows, a.avgdl)[pair]
                        table = np.bincount(cell, weights=weights, minlength=a.n_slots * size).reshape(a.n_slots, size)
                        run = (a.first + np.arange(a.n_slots)) * v + i
                        more = table > kept.least[run][:, None]
                        for s in np.flatnonzero(more.any(axis=1)):
                            kept.add(run[s], table[s][more[s]], docs[more[s]])
        for run in np.flatnonzero(kept.n):
            s, d = kept.cut(run)
            s = np.diff(rounded(s).astype(np.int64)[::-1], prepend=0) if ranks_only else s[::-1].copy()
            yield pa.RecordBatch.from_arrays([pa.array([run], pa.int32()), pa.array([packed(d[::-1].copy())], pa.binary()), pa.array([packed(s)], pa.binary())], ["run", "docs", "scores"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for b in batches:
            for run, docs, scores in zip(b["run"].to_pylist(), b["docs"].to_pylist(), b["scores"].to_pylist(), strict=True):
                d, s = unpacked(docs, np.int64), np.cumsum(unpacked(scores, np.int64)) * 1e-9 if ranks_only else unpacked(scores, np.float64)
                if run in places:
                    d, s = np.concatenate([places[run][0], d]), np.concatenate([places[run][1], s])
                order = np.lexsort((d, -rounded(s)))[:top]
                places[run] = d[order], s[order]
        for run, (d, s) in places.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(d), run, np.int32)), pa.array(np.arange(1, len(d) + 1, dtype=np.int32)), pa.array(d), pa.array(s)], ["run", "rank", "doc_idx", "score"])

    parts = matches.coalesce(tasks).mapInArrow(lean(score), "run int, docs binary, scores binary")
    return parts.repartition("run").mapInArrow(lean(merge), "run int, rank int, doc_idx long, score double")


def entries(rows: Iterable[tuple[int, int, dict[str, float]]], first: int, n_slots: int, n_terms: int, avgdl: float) -> Asked:
    """``Asked`` from ``(term, slot, factors)``."""
    found = sorted(rows, key=lambda r: r[0])
    starts = np.searchsorted(np.array([r[0] for r in found]), np.arange(n_terms + 1))
    kinds = found[0][2] if found else {}
    return Asked(first, n_slots, starts, np.array([r[1] for r in found], np.int64), {k: np.array([r[2][k] for r in found]) for k in kinds}, avgdl)
