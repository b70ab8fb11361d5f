"""Removal of byte strings that also start in an earlier document, by hash-compared suffix sort.

A string of ``length`` bytes is looked for through its anchor: of its ``k``-byte strings the one with
the least hash, the first if several. Neighbouring strings share anchors, so a document is a list of
runs, each a span of bytes around one anchor.

1. Runs go to buckets by their anchor's hash. A run whose whole span occurs in an earlier document is
   removed as a whole; spans are equal if their 128-bit BLAKE2 digests, anchors and lengths are, so no
   polynomial hash decides that. Each task first settles the runs it holds
   itself and sends on only the earliest of equal runs, so a passage of a third of all documents
   costs a few entries per task.
2. Runs that share an anchor but not the span, and the ``side`` bytes before or after it too, as runs
   of equal strings do, fetch their bytes. Around the anchors, the suffixes to
   the right and, reversed, to the left are sorted by a merge sort that compares by words of eight bytes
   and by binary search on prefix polynomial hashes. Neighbours' common extensions are checked byte by
   byte; a bucket where a hash lied is sorted again by its bytes. Classes of equal left and right
   extensions tell which strings occur in earlier documents. Anchors with more than ``hot`` spans are
   dealt out again string by string, as 128-bit digests.
3. Each document gets its ranges and is cut.

Edge cases: null and empty texts, and texts under ``length`` bytes, lose nothing. Rows with a null
doc_id lose nothing and take nothing from others. Rows that share a doc_id are parts of one document:
they take nothing from each other. Every row gives one row. Extra columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from hashlib import blake2b

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gleaner.llm import rolling
from gleaner.llm.common import cut


@dataclass(frozen=True)
class SuffixParams:
    length: int = 50
    k: int = 16
    hot: int = 4_096  # spans of one anchor above which its strings are dealt out singly
    batch_bytes: int = 8_000_000  # text that a task settles at once
    chunk_bytes: int = 4_000_000  # text of a chunk of documents or of a bucket of anchors
    least_chunks: int = 12

    @property
    def side(self) -> int:
        """A string has so many bytes before its anchor or so many after it."""
        return (self.length - self.k + 1) // 2


# Rows travel as packed records of these fields.
RUN = (("key", "u8"), ("span", "u8"), ("more", "u8"), ("doc", "i8"), ("st", "i8"), ("ln", "u1"), ("off", "u1"), ("before", "u2"), ("after", "u2"))
RANGE = (("doc", "i8"), ("st", "i8"), ("n", "i4"))
ASK = (("key", "u8"), ("doc", "i8"), ("st", "i8"), ("ln", "u1"), ("off", "u1"), ("hot", "u1"))
CONTEXT = (("key", "u8"), ("doc", "i8"), ("st", "i8"), ("ln", "u1"), ("off", "u1"))
TEXT = (("row", "i8"), ("doc", "i8"), ("part", "i8"), ("size", "i8"))


@lru_cache(1)
def _press():
    import zstandard

    return zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()


def _records(columns: dict[str, np.ndarray], kind) -> np.ndarray:
    out = np.empty(len(columns[kind[0][0]]), list(kind))
    for c, _ in kind:
        out[c] = columns[c]
    return out


def _all(blobs, kind) -> dict[str, np.ndarray]:
    """Columns of all records of some blobs."""
    rows = np.frombuffer(b"".join(blobs), list(kind))
    return {c: np.ascontiguousarray(rows[c]) for c, _ in kind}


def _pack(rows: np.ndarray, tail: bytes) -> bytes:
    return len(rows).to_bytes(4, "little") + rows.tobytes() + tail


def _unpack(blobs, kind) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """Columns and bytes of blobs of ``_pack``, each in the blobs' order."""
    width, heads, tails = np.dtype(list(kind)).itemsize, [], []
    for b in blobs:
        n = 4 + width * int.from_bytes(b[:4], "little")
        heads.append(b[4:n])
        tails.append(b[n:])
    return _all(heads, kind), np.frombuffer(b"".join(tails), np.uint8)


def _take(columns: dict[str, np.ndarray], rows: np.ndarray) -> dict[str, np.ndarray]:
    return {c: v[rows] for c, v in columns.items()}


def _place(x: np.ndarray, n: int) -> np.ndarray:
    return (rolling.mix(x.astype(np.uint64) ^ np.uint64(0xA5A5A5A5)) % np.uint64(n)).astype(np.int32)


def _cuts(by: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """Rows in the order of ``by``, and of each of its values: value, first row, end."""
    order = np.argsort(by, kind="stable")
    place = by[order]
    at = np.concatenate([np.flatnonzero(np.diff(place, prepend=-1)), [len(by)]])
    return order, list(zip(place[at[:-1]].tolist(), at[:-1].tolist(), at[1:].tolist(), strict=True))


def _dealt(columns: dict[str, np.ndarray], by: np.ndarray, kind) -> Iterator[tuple[int, bytes]]:
    """Records by place. There are as many blobs as senders times places, so one costs no more than a slice."""
    order, cuts = _cuts(by)
    rows = _records(_take({c: columns[c] for c, _ in kind}, order), kind)
    raw, width = rows.tobytes(), rows.itemsize
    for place, i, j in cuts:
        yield place, raw[i * width : j * width]


SLICE = 1 << 18


def _words(buf: np.ndarray) -> np.ndarray:
    """The eight bytes from each place as a number."""
    raw, word = buf.tobytes(), np.empty(len(buf) - 7, np.uint64)
    for i in range(min(8, len(word))):
        word[i::8] = np.frombuffer(raw, np.uint64, len(word[i::8]), i)
    return word


def anchors(buf: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all ``k``-byte strings (8 <= k <= 16) by their start, from their first and last eight bytes."""
    word, n = _words(buf), len(buf) - k + 1
    return rolling.mix(rolling.mix(word[:n]) * np.uint64(0x9E3779B97F4A7C15) + word[k - 8 : k - 8 + n])


def _sides(buf: np.ndarray, at: np.ndarray, p: SuffixParams) -> list[np.ndarray]:
    """16-bit hashes of the ``p.side`` bytes before and after each anchor, in words of eight bytes that may reach into the
    anchor. Of use where the run's span holds those bytes."""
    word, out = _words(buf), []
    for first, step in ((at - p.side, 8), (at + p.k + p.side - 8, -8)):
        h = np.zeros(len(at), np.uint64)
        for i in range(-(-p.side // 8)):
            h = rolling.mix(h * np.uint64(0x9E3779B97F4A7C15) + word[np.clip(first + i * step, 0, len(word) - 1)])
        out.append((h >> np.uint64(48)).astype(np.uint16))
    return out


def find_runs(buf: np.ndarray, offsets: np.ndarray, p: SuffixParams) -> dict[str, np.ndarray]:
    """Runs of strings that share an anchor: ``key, span, more`` (a digest), ``d`` (document index), ``st, ln, off``, and
    ``before, after`` (hashes of the anchor's sides)."""
    L, w = p.length, p.length - p.k + 1
    ok = np.ones(len(buf), bool)  # a string starts here within one document
    for d in range(1, L):
        ends = offsets[1:] - d
        ok[ends[ends >= offsets[:-1]]] = False
    parts = []
    mask = np.uint64((1 << 20) - 1)
    for a in range(0, len(buf) - L + 1, SLICE):
        m = min(SLICE, len(buf) - L + 1 - a)
        g = anchors(buf[a : a + m + L - 1], p.k)
        v = (g & ~mask) | np.arange(len(g), dtype=np.uint64)
        rows = np.concatenate([v, np.full(-len(v) % w, np.iinfo(np.uint64).max, np.uint64)]).reshape(-1, w)
        ahead = np.minimum.accumulate(rows, axis=1).ravel()
        behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
        at = (np.minimum(behind[:m], ahead[w - 1 : w - 1 + m]) & mask).astype(np.int64)
        good = ok[a : a + m]
        turn = np.ones(m, bool)
        turn[1:] = (at[1:] != at[:-1]) | (good[1:] != good[:-1])
        st = np.flatnonzero(turn)
        en = np.concatenate([st[1:], [m]])
        st, en = st[good[st]], en[good[st]]
        raw = memoryview(buf[a : a + m + L - 1].tobytes())
        digests = b"".join(blake2b(raw[i:j], digest_size=16).digest() for i, j in zip(st.tolist(), (en + L - 1).tolist(), strict=True))
        span, more = np.frombuffer(digests, np.uint64).reshape(-1, 2).T
        parts.append((g[at[st]], span, more, st + a, en - st, at[st] - st, *_sides(buf[a : a + m + L - 1], at[st], p)))
    if not parts:
        parts = [(*[np.zeros(0, np.uint64)] * 3, *[np.zeros(0, np.int64)] * 3, *[np.zeros(0, np.uint16)] * 2)]
    key, span, more, st, ln, off, before, after = (np.concatenate(c) for c in zip(*parts, strict=True))
    d = np.searchsorted(offsets, st, side="right") - 1
    return {"key": key, "span": span, "more": more, "d": d, "st": st - offsets[d], "ln": ln, "off": off, "before": before, "after": after}


def settle(runs: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(rows whose span occurs in an earlier document, the other rows); the latter by key and span."""
    if not len(runs["key"]):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    order = np.argsort(runs["key"])
    tie = np.diff(runs["key"][order]) == 0
    tie = np.flatnonzero(np.append(tie, False) | np.insert(tie, 0, False))
    some = order[tie]
    order[tie] = some[np.lexsort([runs[c][some] for c in ("st", "doc", "ln", "more", "span", "key")])]
    same = [runs[c][order] for c in ("key", "span", "more", "ln")]
    doc, new = runs["doc"][order], np.ones(len(order), bool)
    new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in same])
    late = doc > doc[np.flatnonzero(new)][np.cumsum(new) - 1]
    return order[late], order[~late]


def _ranges(runs: dict[str, np.ndarray], rows: np.ndarray, p: SuffixParams) -> dict[str, np.ndarray]:
    return {"doc": runs["doc"][rows], "st": runs["st"][rows], "n": runs["ln"][rows].astype(np.int64) + p.length - 1}


def _frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["kind", "at", "blob"])


PACKED = "kind int, at int, blob binary"  # 0: runs or contexts of a bucket; 1: ranges of a chunk; 2: requests of a chunk; 3: single strings of a bucket


def _merge_ranges(r: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """Join overlapping and touching ranges of a document."""
    if not len(r["doc"]):
        return r
    order = np.lexsort((r["st"], r["doc"]))
    doc, st = r["doc"][order], r["st"][order]
    end = st + r["n"][order]
    first = np.ones(len(doc), bool)
    first[1:] = doc[1:] != doc[:-1]
    group = np.cumsum(first) - 1
    lift = group * (1 << 45)  # keeps the running maximum within a document
    base = st[first][group]
    top = np.maximum.accumulate(end - base + lift) - lift + base
    new = first.copy()
    new[1:] |= st[1:] > top[:-1]
    at = np.flatnonzero(new)
    last = np.concatenate([at[1:], [len(doc)]]) - 1
    n = top[last] - st[at]
    return {"doc": doc[at], "st": st[at], "n": n}


def runs_of(docs: DataFrame, buckets: int, p: SuffixParams) -> DataFrame:
    """Packed runs by bucket and the ranges that each task settled itself, from ``doc, part, text``."""

    def of(held: list[tuple]) -> Iterator[tuple]:
        doc, part = (np.concatenate([h[i] for h in held]) for i in (0, 1))
        buf = np.concatenate([h[2] for h in held])
        sizes = np.concatenate([np.diff(h[3]) for h in held])
        runs = find_runs(buf, np.concatenate([[0], np.cumsum(sizes)]), p)
        d = runs.pop("d")
        runs |= {"doc": doc[d], "st": runs["st"] + (part[d] << 32)}
        late, rest = settle(runs)
        if len(late):
            r = _merge_ranges(_ranges(runs, late, p))
            for at, blob in _dealt(r, _place(r["doc"], buckets), RANGE):
                yield 1, at, blob
        rest = np.sort(rest)  # as they stand in the texts, which packs well
        for at, blob in _dealt(_take(runs, rest), _place(runs["key"][rest], buckets), RUN):
            yield 0, at, _press()[0].compress(blob)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            rows = list(of(held))
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.binary())],
                names=["kind", "at", "blob"],
            )

        for batch in batches:
            buf, at = rolling.buffers(batch.column(2))
            doc, part = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in (0, 1))
            for i, j in rolling.groups_of(at, p.batch_bytes):
                if held and size + at[j] - at[i] > p.batch_bytes:
                    yield from flush()
                    held, size = [], 0
                held.append((doc[i:j], part[i:j], buf[at[i] : at[j]], at[i : j + 1] - at[i]))
                size += int(at[j] - at[i])
        if held:
            yield from flush()

    return docs.select("doc", "part", "text").mapInArrow(run, PACKED)


def texts_of(docs: DataFrame, chunks: int) -> DataFrame:
    """Packed texts by chunk of documents: ``at, blob``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, at = rolling.buffers(batch.column(2))
            doc, part = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in (0, 1))
            (order, cuts), rows = _cuts(_place(doc, chunks)), []
            heads = _records({"row": order, "doc": doc[order], "part": part[order], "size": np.diff(at)[order]}, TEXT)
            for place, i, j in cuts:
                tail = b"".join(buf[at[r] : at[r + 1]].tobytes() for r in order[i:j].tolist())
                rows.append((place, _press()[0].compress(_pack(heads[i:j], tail))))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], names=["at", "blob"])

    return docs.select("doc", "part", "text").mapInArrow(run, "at int, blob binary")


def _texts(blobs) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(doc, part, bytes, offsets) of a chunk."""
    got, buf = _unpack((_press()[1].decompress(b) for b in blobs), TEXT)
    return got["doc"], got["part"], buf, np.concatenate([[0], np.cumsum(got["size"])])


def shared(runs: dict[str, np.ndarray], p: SuffixParams) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """(rows, ``st, ln, off`` there) of runs, given by key, cut to the strings that another document may hold.

    Of a string's ``length - k`` bytes beside the anchor, ``p.side`` stand before or after it. So a string can only occur
    in a document that has this anchor with the same ``p.side`` bytes on that side, on both if both are so long. Common
    anchors of different texts end here, without a look at their bytes; their number grows faster than the texts.
    """
    off, ln = runs["off"].astype(np.int64), runs["ln"].astype(np.int64)
    new = np.ones(len(off), bool)
    new[1:] = runs["key"][1:] != runs["key"][:-1]
    group = np.cumsum(new)
    alone = np.bincount(group)[group] < 2
    found = {}
    for side, size in (("before", off), ("after", ln + p.length - 1 - off - p.k)):
        found[side] = np.zeros(len(off), bool)
        rows = np.flatnonzero(~alone & (size >= p.side))
        kind = group[rows] << 16 | runs[side][rows]
        order = np.argsort(kind, kind="stable")
        rows, first = rows[order], np.diff(kind[order], prepend=-1) != 0
        start, doc = np.flatnonzero(first), runs["doc"][rows]
        if len(start):
            several = np.minimum.reduceat(doc, start) != np.maximum.reduceat(doc, start)
            found[side][rows[several[np.cumsum(first) - 1]]] = True
    high = np.where(found["before"], off, np.minimum(off, p.side - 1))  # bytes before the anchor, of the first string
    low = np.where(found["after"], off - ln + 1, np.maximum(off - ln + 1, p.length - p.k - p.side + 1))  # and of the last
    rows = np.flatnonzero(low <= high)
    return rows, {"st": (runs["st"] + off - high)[rows], "ln": (high - low + 1)[rows], "off": high[rows]}


def meet(pdf: pd.DataFrame, buckets: int, p: SuffixParams) -> pd.DataFrame:
    """Settle the runs of a bucket; ask for the bytes of strings that other documents may hold."""
    out = [(1, int(a), b) for k, a, b in zip(pdf["kind"], pdf["at"], pdf["blob"], strict=True) if k == 1]
    runs = _all((_press()[1].decompress(b) for b in pdf["blob"][pdf["kind"] == 0]), RUN)
    late, rest = settle(runs)
    if len(late):
        r = _ranges(runs, late, p)
        out += [(1, at, blob) for at, blob in _dealt(r, _place(r["doc"], buckets), RANGE)]
    runs = _take(runs, rest)
    rows, cut_to = shared(runs, p)
    if len(rows):
        found = _take(runs, rows) | cut_to
        key, span, more = (found[c] for c in ("key", "span", "more"))
        new = np.ones(len(rows), bool)
        new[1:] = key[1:] != key[:-1]
        other = np.ones(len(rows), bool)
        other[1:] = (span[1:] != span[:-1]) | (more[1:] != more[:-1]) | new[1:]
        found["hot"] = (np.add.reduceat(other.astype(np.int64), np.flatnonzero(new)) > p.hot)[np.cumsum(new) - 1]
        out += [(2, at, blob) for at, blob in _dealt(found, _place(found["doc"], buckets), ASK)]
    return _frame(out)


def _rows_of(doc: np.ndarray, part: np.ndarray, want_doc: np.ndarray, want_part: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row of each wanted (doc, part), and the rows in that order; of repeated rows the first."""
    order = np.lexsort((part, doc))
    pairs = np.rec.fromarrays([doc[order], part[order]])
    want = np.rec.fromarrays([want_doc, want_part], dtype=pairs.dtype)
    at = np.searchsorted(pairs, want)
    return order[at], order


def _single(buf: np.ndarray, spans: dict[str, np.ndarray], p: SuffixParams) -> dict[str, np.ndarray]:
    """The strings of spans one by one, each its own anchor."""
    parts = []
    for at in range(0, len(spans["ln"]), 2_000):
        h = {c: v[at : at + 2_000] for c, v in spans.items()}
        n = h["ln"].astype(np.int64)
        size = n + p.length - 1
        base = np.cumsum(size) - size
        s = rolling.prefix(buf[np.repeat(h["begin"] - base, size) + np.arange(size.sum())])
        i = np.repeat(np.arange(len(n)), n)
        step = np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n)
        key = rolling.mix(rolling.window(s, base[i] + step, base[i] + step + p.length))
        flat = np.ones(len(i), np.uint8)
        parts.append({"key": key, "span": key, "more": key, "doc": h["doc"][i], "st": h["st"][i] + step, "begin": h["begin"][i] + step, "ln": flat, "off": flat - 1})
    return {c: np.concatenate([x[c] for x in parts]) for c in parts[0]}


def contexts(texts: pd.DataFrame, asks: pd.DataFrame, buckets: int, p: SuffixParams) -> pd.DataFrame:
    """Bytes of the requested spans of a chunk, by bucket; strings of hot anchors one by one, as digests."""
    out: list[tuple] = []
    ask = _all(asks["blob"], ASK)
    if not len(ask["doc"]):
        return _frame(out)
    doc, part, buf, at = _texts(texts["blob"])
    row, _ = _rows_of(doc, part, ask["doc"], ask["st"] >> 32)
    begin = at[row] + (ask["st"] & 0xFFFFFFFF)
    hot = ask["hot"] > 0
    cold = _take({**ask, "begin": begin}, np.flatnonzero(~hot))
    if hot.any():
        one = _single(buf, _take({**ask, "begin": begin}, np.flatnonzero(hot)), p)
        late, rest = settle(one)
        # Of equal strings in this chunk the bytes decide.
        same = rest[np.searchsorted(one["key"][rest], one["key"][late])]
        eq = np.zeros(len(late), bool)
        for k in range(0, len(late), 20_000):
            x, y = (one["begin"][i[k : k + 20_000]][:, None] + np.arange(p.length) for i in (late, same))
            eq[k : k + 20_000] = (buf[x] == buf[y]).all(1)
        r = _merge_ranges(_ranges(one, late[eq], p))
        out += [(1, a, b) for a, b in _dealt(r, _place(r["doc"], buckets), RANGE)]
        # Those of different chunks meet by the digests of their bytes.
        one = _take(one, np.concatenate([rest, late[~eq]]))
        raw = memoryview(buf.tobytes())
        digests = b"".join(blake2b(raw[i : i + p.length], digest_size=16).digest() for i in one["begin"].tolist())
        one["span"], one["more"] = np.frombuffer(digests, np.uint64).reshape(-1, 2).T
        one["before"] = one["after"] = one["off"]
        out += [(3, a, _press()[0].compress(b)) for a, b in _dealt(one, _place(one["key"], buckets), RUN)]
    order, cuts = _cuts(_place(cold["key"], buckets))
    cold = _take(cold, order)
    size, parts = cold["ln"].astype(np.int64) + p.length - 1, []
    for k in range(0, len(size), 20_000):
        some = size[k : k + 20_000]
        i = np.repeat(cold["begin"][k : k + 20_000] - np.cumsum(some) + some, some) + np.arange(some.sum())
        parts.append(buf[i].tobytes())
    rows, raw, end = _records(cold, CONTEXT), b"".join(parts), np.concatenate([[0], np.cumsum(size)])
    out += [(0, place, _pack(rows[i:j], raw[end[i] : end[j]])) for place, i, j in cuts]
    return _frame(out)


def _common(s: np.ndarray, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Length of the common extension from a and b, at most ``most``: binary search on prefix hashes."""
    low, high = np.zeros(len(a), np.int64), most.astype(np.int64)
    while (open_ := low < high).any():
        mid = (low + high + 1) >> 1
        same = rolling.window(s, a, a + mid) == rolling.window(s, b, b + mid)
        low, high = np.where(open_ & same, mid, low), np.where(open_ & ~same, mid - 1, high)
    return low


WORDS = 4


def _first_words(buf: np.ndarray, start: np.ndarray, size: np.ndarray, skip: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each suffix, from byte ``skip``, up to ``WORDS`` words of eight bytes as numbers that sort like them, and how many it has."""
    have = np.clip((size - skip) >> 3, 0, WORDS)
    words = np.zeros((WORDS, len(start)), np.uint64)
    if len(buf) >= 8:
        word = _words(buf)
        for c in range(WORDS):
            rows = np.flatnonzero(have > c)
            words[c, rows] = word[start[rows] + skip + 8 * c].byteswap()
    return words, have


def _before(buf, s, start, size, first, i, j) -> np.ndarray:
    """Does suffix i sort before suffix j? Equal ones keep the order of their numbers. Their first words decide, else hashes."""
    words, have = first
    out, todo = np.zeros(len(i), bool), np.arange(len(i))
    both = np.minimum(have[i], have[j])
    for c, word in enumerate(words):
        x, y = word[i[todo]], word[j[todo]]
        told = (x != y) & (both[todo] > c)
        out[todo[told]] = x[told] < y[told]
        todo = todo[~told]
    if len(todo):
        i, j = i[todo], j[todo]
        a, b, most = start[i], start[j], np.minimum(size[i], size[j])
        n = _common(s, a, b, most)
        end = n >= most
        x, y = buf[np.minimum(a + n, len(buf) - 1)], buf[np.minimum(b + n, len(buf) - 1)]
        out[todo] = np.where(end, (size[i] < size[j]) | ((size[i] == size[j]) & (i < j)), x < y)
    return out


def suffix_order(buf: np.ndarray, start: np.ndarray, size: np.ndarray, group: np.ndarray, skip: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(order of the suffixes within their groups, common extension with the one before; 0 at a group's start).

    ``group`` ascends. Merge sort over all groups at once: each suffix finds its place in the
    neighbouring run by binary search, each comparison by words of eight bytes, then by binary search on
    prefix hashes. A group's suffixes should begin with the same ``skip`` bytes, which saves comparing them.
    """
    n = len(start)
    order = np.arange(n)
    if not n:
        return order, order
    s = rolling.prefix(buf, 1)  # the order is checked below
    first = _first_words(buf, start, size, skip)
    base = np.searchsorted(group, group, side="left")
    count = np.searchsorted(group, group, side="right") - base
    width = 1
    while (active := np.flatnonzero(count > width)).size:
        q = active - base[active]  # place within the group
        mate = (q // width) ^ 1
        lo = mate * width
        hi = np.minimum(lo + width, count[active])
        has = lo < count[active]
        active, q, lo, hi, mate = active[has], q[has], lo[has], hi[has], mate[has]
        own, b = order[active], base[active]
        left, right = lo.copy(), hi.copy()
        while (todo := np.flatnonzero(left < right)).size:
            mid = (left[todo] + right[todo]) >> 1
            less = _before(buf, s, start, size, first, order[b[todo] + mid], own[todo])
            left[todo] = np.where(less, mid + 1, left[todo])
            right[todo] = np.where(less, right[todo], mid)
        place = b + np.minimum(lo, (q // width) * width) + q % width + (left - lo)
        merged = order.copy()
        merged[place] = own
        order = merged
        width *= 2
    lcp = np.zeros(n, np.int64)
    near = np.flatnonzero(group[1:] == group[:-1]) + 1
    i, j = order[near - 1], order[near]
    most = np.minimum(size[i], size[j])
    lcp[near] = _common(s, start[i], start[j], most)
    # Verification: the extension's bytes are equal, and the next ones are in order.
    for at in range(0, len(near), 20_000):
        part = slice(at, at + 20_000)
        c, a, b, m = lcp[near][part], start[i[part]], start[j[part]], most[part]
        steps = np.arange(int(c.max(initial=0)))
        x, y = (buf[np.minimum(v[:, None] + steps, len(buf) - 1)] for v in (a, b))
        wrong = ((x != y) & (steps < c[:, None])).any(1)
        ends = c >= m
        nx, ny = buf[np.minimum(a + c, len(buf) - 1)], buf[np.minimum(b + c, len(buf) - 1)]
        if wrong.any() or (~ends & (nx >= ny)).any():
            return sorted_by_bytes(buf, start, size, group)
    return order, lcp


def sorted_by_bytes(buf: np.ndarray, start: np.ndarray, size: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same by plain comparison of bytes."""
    raw = buf.tobytes()
    text = [raw[a : a + n] for a, n in zip(start.tolist(), size.tolist(), strict=True)]
    order = np.asarray(sorted(range(len(text)), key=lambda i: (group[i], text[i], i)), np.int64)
    lcp = np.zeros(len(order), np.int64)
    for k in range(1, len(order)):
        a, b = order[k - 1], order[k]
        if group[a] == group[b]:
            x, y = text[a], text[b]
            lcp[k] = next((c for c, (u, v) in enumerate(zip(x, y, strict=False)) if u != v), min(len(x), len(y)))
    return order, lcp


def compare(pdf: pd.DataFrame, buckets: int, p: SuffixParams) -> pd.DataFrame:
    """Ranges of the strings of a bucket's contexts that occur in earlier documents."""
    out = [(1, int(a), b) for k, a, b in zip(pdf["kind"], pdf["at"], pdf["blob"], strict=True) if k == 1]
    one = _all((_press()[1].decompress(b) for b in pdf["blob"][pdf["kind"] == 3]), RUN)
    late, _ = settle(one)
    if len(late):
        r = _merge_ranges(_ranges(one, late, p))
        out += [(1, at, blob) for at, blob in _dealt(r, _place(r["doc"], buckets), RANGE)]
    c, buf = _unpack(pdf["blob"][pdf["kind"] == 0], CONTEXT)
    if not len(buf):
        return _frame(out)
    ln, off = c["ln"].astype(np.int64), c["off"].astype(np.int64)
    begin = np.cumsum(ln + p.length - 1) - (ln + p.length - 1)
    order = np.argsort(c["key"], kind="stable")
    key = c["key"][order]
    first = np.ones(len(key), bool)
    first[1:] = key[1:] != key[:-1]
    group = np.cumsum(first) - 1
    doc, st, ln, off, begin = c["doc"][order], c["st"][order], ln[order], off[order], begin[order]
    anchor = begin + off
    right, r_lcp = suffix_order(buf, anchor, ln + p.length - 1 - off, group, p.k)
    left, l_lcp = suffix_order(buf[::-1].copy(), len(buf) - anchor, off, group)
    found_doc, found_st = [], []
    edge = first
    for o in range(p.length - p.k + 1):
        rows = np.flatnonzero((o <= off) & (o > off - ln))
        if len(rows) < 2:
            continue
        l_id, r_id = np.empty(len(key), np.int64), np.empty(len(key), np.int64)
        l_id[left] = np.cumsum(edge | (l_lcp < o))
        r_id[right] = np.cumsum(edge | (r_lcp < p.length - o))
        kind = l_id[rows] * (len(key) + 2) + r_id[rows]
        by = np.lexsort((doc[rows], kind))
        k, d = kind[by], doc[rows][by]
        new = np.ones(len(by), bool)
        new[1:] = k[1:] != k[:-1]
        late = d > d[np.flatnonzero(new)][np.cumsum(new) - 1]
        hit = rows[by[late]]
        found_doc.append(doc[hit])
        found_st.append(st[hit] + off[hit] - o)
    if found_doc:
        d, s = np.concatenate(found_doc), np.concatenate(found_st)
        r = _merge_ranges({"doc": d, "st": s, "n": np.full(len(d), p.length, np.int64)})
        out += [(1, at, blob) for at, blob in _dealt(r, _place(r["doc"], buckets), RANGE)]
    return _frame(out)


def cut_texts(texts: pd.DataFrame, ranges: pd.DataFrame, spans: bool) -> pd.DataFrame:
    """Results of a chunk's documents."""
    doc, part, buf, at = _texts(texts["blob"])
    r = _all(ranges["blob"], RANGE)
    delta = np.zeros(len(buf) + 1, np.int32)
    if len(r["doc"]):
        # Repeated rows have the same ranges: look them up from the documents' side.
        order = np.lexsort((r["st"], r["doc"]))
        key = np.rec.fromarrays([r["doc"][order], r["st"][order] >> 32])
        own = np.rec.fromarrays([doc, part], dtype=key.dtype)
        lo, hi = np.searchsorted(key, own, side="left"), np.searchsorted(key, own, side="right")
        i = np.repeat(np.arange(len(doc)), hi - lo)
        k = order[np.arange(len(i)) - np.repeat(np.cumsum(hi - lo) - (hi - lo), hi - lo) + np.repeat(lo, hi - lo)]
        begin = at[i] + (r["st"][k] & 0xFFFFFFFF)
        np.add.at(delta, begin, 1)
        np.add.at(delta, begin + r["n"][k], -1)
    gone = np.cumsum(delta[:-1], dtype=np.int32) > 0
    del delta
    total = np.zeros(len(gone) + 1, np.int64)
    np.cumsum(gone, out=total[1:])
    gone_by, k_at = np.diff(total[at]), at - total[at]
    rises = gone.copy()
    rises[1:] &= ~gone[:-1]
    inner = at[:-1][at[:-1] < len(buf)]
    rises[inner] = gone[inner]
    np.cumsum(rises, out=total[1:])
    kept = buf[~gone].tobytes()
    out = pd.DataFrame(
        {
            "doc_id": doc,
            "n_bytes": np.diff(at),
            "n_removed": gone_by,
            "n_spans": np.diff(total[at]),
            "kept_sha256": [hashlib.sha256(kept[a:b]).hexdigest() for a, b in zip(k_at[:-1].tolist(), k_at[1:].tolist(), strict=True)],
        }
    )
    if spans:
        out["kept"] = [kept[a:b] for a, b in zip(k_at[:-1].tolist(), k_at[1:].tolist(), strict=True)]
    return out


def remove_repeats(docs: DataFrame, params: SuffixParams = SuffixParams(), kept: bool = False) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` for every row; with ``kept`` the bytes that stay too."""
    p = params
    rows = docs.select(F.col("doc_id").cast("long").alias("doc"), "text")
    named = rows.where("doc IS NOT NULL")
    again = named.groupBy("doc").count().where("count > 1").select("doc")
    if again.isEmpty():
        named = named.withColumn("part", F.lit(0).cast("long"))
    else:  # different texts under one id get numbers of their own
        several = named.join(again, "doc", "left_semi")
        number = F.dense_rank().over(Window.partitionBy("doc").orderBy(F.md5(F.coalesce("text", F.lit("")))))
        named = (
            named.join(again, "doc", "left_anti").withColumn("part", F.lit(0).cast("long"))
            .unionByName(several.withColumn("part", (number - 1).cast("long")))
        )
    total = named.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    n = max(p.least_chunks, -(-total // p.chunk_bytes))
    met = runs_of(named, n, p).groupBy(F.when(F.col("kind") == 0, F.col("at")).otherwise(F.pmod(F.xxhash64("blob"), F.lit(n)).cast("int")).alias("bucket"))
    met = cut(met.applyInPandas(lambda pdf: meet(pdf, n, p), PACKED))
    texts = texts_of(named, n)
    asks = met.where("kind = 2").select("at", "blob")
    got = cut(texts.groupBy("at").cogroup(asks.groupBy("at")).applyInPandas(lambda t, a: contexts(t, a, n, p), PACKED))
    bucket = F.when(F.col("kind") != 1, F.col("at")).otherwise(F.pmod(F.xxhash64("blob"), F.lit(n)).cast("int")).alias("bucket")
    compared = got.groupBy(bucket).applyInPandas(lambda pdf: compare(pdf, n, p), PACKED)
    ranges = met.where("kind = 1").select("at", "blob").unionByName(compared.select("at", "blob"))
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept binary" if kept else "")
    out = texts.groupBy("at").cogroup(ranges.groupBy("at")).applyInPandas(lambda t, r: cut_texts(t, r, kept), schema)
    text = F.coalesce("text", F.lit(""))
    zero = F.lit(0).cast("long")
    rest = rows.where("doc IS NULL").select(
        F.col("doc").alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"), zero.alias("n_removed"), zero.alias("n_spans"),
        F.sha2(text, 256).alias("kept_sha256"), *([text.cast("binary").alias("kept")] if kept else []),
    )
    return out.unionByName(rest)


def oracle(length: int = 50) -> str:
    """Every string of every document in DuckDB SQL, on hexadecimal texts."""
    return f"""WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
p AS (SELECT doc_id, h, unnest(range(greatest(len(h) // 2 - {length - 1}, 0))) AS i FROM d),
w AS (SELECT doc_id, i, substr(h, 2 * i + 1, {2 * length}) AS s FROM p),
f AS (SELECT s, min(doc_id) AS m FROM w GROUP BY 1),
r AS (SELECT doc_id, i AS a, i + {length} AS b FROM w JOIN f USING (s) WHERE m < doc_id),
o AS (SELECT *, max(b) OVER (PARTITION BY doc_id ORDER BY a ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM r),
g AS (SELECT doc_id, a, b, count(*) FILTER (before IS NULL OR a > before) OVER (PARTITION BY doc_id ORDER BY a) AS k FROM o),
x AS (SELECT doc_id, k, min(a) AS a, max(b) AS b FROM g GROUP BY ALL),
y AS (SELECT *, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS z FROM x),
c AS (SELECT doc_id, sum(b - a)::BIGINT AS gone, count(*) AS spans, string_agg(substr(h, 2 * z + 1, 2 * (a - z)), '' ORDER BY a) || substr(any_value(h), 2 * max(b) + 1) AS kept FROM y JOIN d USING (doc_id) GROUP BY 1)
SELECT d.doc_id, len(h) // 2 AS n_bytes, coalesce(gone, 0) AS n_removed, coalesce(spans, 0) AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256 FROM d LEFT JOIN c USING (doc_id)"""
