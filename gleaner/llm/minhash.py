"""MinHash near-duplicates with sequential Bayesian verification.

1. Every document's set of word shingles is hashed to 64 bits; sets that are equal (128-bit sums and
   size) form one class, and one representative of a class goes on.
2. Bands of minimum hashes put representatives into buckets; buckets with the same members count once.
3. Inside a bucket, pairs compare their one-byte signatures batch by batch. After each batch a pair
   whose posterior chance to reach the threshold is below ``miss`` drops out. Of the survivors, a
   maximum spanning forest per bucket is verified on the whole sets.
4. Then documents that share a bucket but no component meet once more: those outside a bucket's
   largest component meet all members of that component, and each other, in bounded blocks that hold
   signatures and texts. Survivors are verified in place, so only links leave a block. Nothing is
   capped: a pair is skipped only if its documents are in one component already.

A pair at similarity s misses all bands with probability (1 - s**5)**25: 5e-7 at 0.85, 5e-5 at 0.8.

Links are confirmed on words themselves, numbered within a task, not on hashes. Hashes (two of 64 bits and
the size) alone say that two sets are equal, and a set's size counts 64-bit hashes.

Edge cases: null or empty texts, and texts without words, have an empty set and link with nothing.
Rows with a null doc_id link with nothing and are kept. Rows that share a doc_id are one document.
Repeated rows give repeated results. Extra columns are not read. Empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm import rolling
from gleaner.llm.common import cut
from gleaner.llm.components import components


@dataclass(frozen=True)
class MinHashParams:
    words: int = 5
    num: int = 80  # a pair links if den * |A & B| >= num * |A | B|
    den: int = 100
    bands: int = 25
    rows: int = 5
    hashes: int = 128
    batch: int = 32  # signature values compared at a time
    miss: float = 1e-6  # posterior chance below which a pair is given up
    tile: int = 1_024  # members of a bucket that one block compares
    part_rows: int = 20_000  # bucket members per task
    block_rows: int = 4_000  # rows of blocks per task
    large_class: int = 10_000  # a class of more copies never meets its rows by shuffle
    most_large: int = 10_000
    salts: int = 8  # parts of a bucket's members in joins
    few_ids: int = 1_000_000  # so many ids (8 MB) may be broadcast; more are joined by shuffle


_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def shingle_sets(buf: np.ndarray, offsets: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """(document index, hash) of the distinct shingles of each text, ascending by both."""
    n = len(offsets) - 1
    if not len(buf):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    b = _LOWER[buf]
    gap = np.ones(len(b) + 1, bool)
    gap[:-1] = _SPACE[b]
    first = np.zeros(len(b) + 1, bool)
    first[offsets] = True
    begins = np.flatnonzero(~gap[:-1] & (np.concatenate([[True], gap[:-2]]) | first[:-1]))
    ends = np.flatnonzero(~gap[:-1] & (gap[1:] | first[1:])) + 1
    w = rolling.mix(rolling.window(rolling.prefix(b), begins, ends) + (ends - begins).astype(np.uint64))
    doc = np.searchsorted(offsets, begins, side="right") - 1
    count = np.bincount(doc, minlength=n)
    start = np.concatenate([[0], np.cumsum(count)])[:-1]
    size = np.minimum(count, words)  # shorter texts are one shingle
    at = np.flatnonzero(np.arange(len(w)) - start[doc] <= (count - size)[doc])
    d, h = doc[at], size[doc[at]].astype(np.uint64)
    for k in range(words):
        use = size[d] > k
        step = rolling.mix(h[use] * np.uint64(0xD6E8FEB86659FD93) + w[at[use] + k])
        h[use] = step
    order = np.argsort(h, kind="stable")
    order = order[np.argsort(d[order], kind="stable")]
    d, h = d[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
    return d[new], h[new]


def exact_sets(texts: list[bytes], words: int) -> tuple[np.ndarray, np.ndarray]:
    """(text index, number) of the distinct shingles of each text; equal numbers are equal shingles, word by word."""
    table: dict[bytes, int] = {}
    lists = [[table.setdefault(w, len(table) + 1) for w in t.translate(_LOWER.tobytes()).split()] for t in texts]
    count = np.array([len(x) for x in lists], np.int64)
    n = np.where(count == 0, 0, np.maximum(1, count - words + 1))  # shorter texts are one shingle, filled up with zeros
    flat = np.concatenate([np.asarray(x + [0] * words, np.int64) for x in lists] or [np.zeros(0, np.int64)])
    start = np.cumsum(count + words) - (count + words)
    d = np.repeat(np.arange(len(texts)), n)
    at = start[d] + np.arange(len(d)) - np.repeat(np.cumsum(n) - n, n)
    name = flat[at]
    for k in range(1, words):  # a pair of numbers gets a number
        _, name = np.unique(name * (len(table) + 1) + flat[at + k], return_inverse=True)
    both = np.unique(d * (len(name) + len(table) + 1) + name)
    return both // (len(name) + len(table) + 1), both % (len(name) + len(table) + 1)


def linked(texts: list[bytes], p: MinHashParams) -> np.ndarray:
    """For n pairs given as n texts and then their n partners: which reach the threshold on whole sets."""
    n = len(texts) // 2
    d, name = exact_sets(texts, p.words)
    size = np.bincount(d, minlength=2 * n)
    pair = d % max(n, 1)  # a set has no repeats, so a shingle that a pair has twice is shared
    order = np.lexsort((name, pair))
    same = (name[order][1:] == name[order][:-1]) & (pair[order][1:] == pair[order][:-1])
    both = np.bincount(pair[order][1:][same], minlength=n)
    return (both > 0) & (p.den * both >= p.num * (size[:n] + size[n:] - both))


def _constants(n: int, salt: int) -> np.ndarray:
    return rolling.mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(salt)) | np.uint64(1)


def signatures(d: np.ndarray, h: np.ndarray, n: int, p: MinHashParams) -> dict[str, np.ndarray]:
    """Per document: set size, two sums that identify the set, one-byte signature, band hashes."""
    size = np.bincount(d, minlength=n)
    full = np.flatnonzero(size)
    sums = np.zeros((2, n), np.uint64)
    sig, bands = np.zeros((n, p.hashes), np.uint8), np.zeros((n, p.bands), np.uint64)
    if len(full):
        starts = np.concatenate([[0], np.cumsum(size[full])])[:-1]
        sums[0, full] = np.add.reduceat(rolling.mix(h), starts)
        sums[1, full] = np.add.reduceat(rolling.mix(h ^ np.uint64(0x5851F42D4C957F2D)), starts)
        low = np.empty((len(full), p.hashes), np.uint64)
        for i, a in enumerate(_constants(p.hashes, 7)):
            low[:, i] = np.minimum.reduceat(h * a, starts)
        low = rolling.mix(low)
        sig[full] = (low >> np.uint64(56)).astype(np.uint8)
        for k, salt in enumerate(_constants(p.bands, 11)):
            x = np.full(len(full), salt)
            for i in range(k * p.rows, (k + 1) * p.rows):
                x = rolling.mix(x * np.uint64(0xD6E8FEB86659FD93) + low[:, i])
            bands[full, k] = x
    return {"size": size, "a": sums[0], "b": sums[1], "sig": sig, "bands": bands}


def least_matches(p: MinHashParams) -> list[int]:
    """For each number n of compared values the least matches at which a pair stays.

    With a flat prior on the match probability, the posterior chance that it is x or more after m
    matches of n is P(Binomial(n + 1, x) <= m). x allows for one-byte values that agree by chance.
    """
    t = p.num / p.den
    x = t + (1 - t) / 256
    out = []
    for n in range(p.batch, p.hashes + 1, p.batch):
        chance, m = 0.0, 0
        while m <= n:
            chance += comb(n + 1, m) * x**m * (1 - x) ** (n + 1 - m)
            if chance >= p.miss:
                break
            m += 1
        out.append(m)
    return out


def survivors(sig: np.ndarray, i: np.ndarray, j: np.ndarray, p: MinHashParams, least: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """(positions into i and j that stay, their matches), compared batch by batch."""
    stay, seen = np.arange(len(i)), np.zeros(len(i), np.int32)
    for k, m in enumerate(least):
        cols = slice(k * p.batch, (k + 1) * p.batch)
        seen = seen + (sig[i[stay], cols] == sig[j[stay], cols]).sum(1, dtype=np.int32)
        ok = seen >= m
        stay, seen = stay[ok], seen[ok]
    return stay, seen


def _segments(key: np.ndarray) -> list[tuple[int, int]]:
    cuts = np.flatnonzero(key[1:] != key[:-1]) + 1
    ends = np.concatenate([cuts, [len(key)]])
    return list(zip(np.concatenate([[0], cuts]).tolist(), ends.tolist(), strict=True))


def _small_pairs(spans: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All pairs within each short segment, with the segment's number."""
    by: dict[int, list[tuple[int, int]]] = {}
    for g, (s, e) in enumerate(spans):
        by.setdefault(e - s, []).append((g, s))
    out = [[np.zeros(0, np.int64)] * 3]
    for m, found in by.items():
        if m > 1:
            x, y = np.triu_indices(m, 1)
            g, s = np.asarray(found, np.int64).T
            out.append([np.repeat(g, len(x)), (s[:, None] + x).ravel(), (s[:, None] + y).ravel()])
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


SMALL = 32


def forest(key: np.ndarray, node: np.ndarray, sig: np.ndarray, p: MinHashParams) -> set[tuple[int, int]]:
    """Edges of a maximum spanning forest of the surviving pairs of each bucket; ``key`` ascends."""
    least, edges = least_matches(p), set()
    spans = _segments(key)
    small = [x for x in spans if x[1] - x[0] <= SMALL]
    for at in range(0, len(small), 20_000):
        g, i, j = _small_pairs(small[at : at + 20_000])
        stay, seen = survivors(sig, i, j, p, least)
        g, i, j = g[stay], i[stay], j[stay]
        up: dict[int, int] = {}

        def root(x: int, up: dict[int, int] = up) -> int:
            while (y := up.get(x, x)) != x:
                up[x] = x = up.get(y, y)
            return x

        order = np.lexsort((j, i, -seen, g))
        for a, b in zip(i[order].tolist(), j[order].tolist(), strict=True):
            ra, rb = root(a), root(b)
            if ra != rb:
                up[ra] = rb
                edges.add((min(node[a], node[b]), max(node[a], node[b])))
    for s, e in spans:
        if e - s <= SMALL:
            continue
        left = np.arange(s, e)
        best, source = np.zeros(e - s, np.int32), np.full(e - s, -1)
        todo = np.ones(e - s, bool)
        for _ in range(e - s):  # Prim's algorithm: the row of one member at a time
            x = int(np.argmax(np.where(todo, best, -1)))
            todo[x] = False
            if best[x]:
                a, b = node[s + x], node[s + source[x]]
                edges.add((min(a, b), max(a, b)))
            rest = np.flatnonzero(todo)
            stay, seen = survivors(sig, np.full(len(rest), s + x), left[rest], p, least)
            to = rest[stay]
            better = seen > best[to]
            best[to[better]], source[to[better]] = seen[better], x
    return {(int(a), int(b)) for a, b in edges if a != b}


def crossing(key: np.ndarray, node: np.ndarray, comp: np.ndarray, side: np.ndarray, sig: np.ndarray, z: list[bytes], p: MinHashParams) -> set[tuple[int, int]]:
    """Verified links between components: within side 0, or between sides 0 and 1, of each block; ``key``
    ascends. Once a link joins two components of a block, no further pair of the two is looked at."""
    import zstandard

    least, links, open_ = least_matches(p), set(), zstandard.ZstdDecompressor()
    for s, e in _segments(key):
        zero = np.flatnonzero(side[s:e] == 0) + s
        one = np.flatnonzero(side[s:e] == 1) + s
        if not len(zero) or len(zero) + len(one) < 2:
            continue
        now = comp[s:e].copy()
        sets: dict[int, np.ndarray] = {}

        def shingles(x: int, sets: dict[int, np.ndarray] = sets) -> np.ndarray:
            if x not in sets:
                data = open_.decompress(z[x]) if z[x] else b""
                sets[x] = shingle_sets(np.frombuffer(data, np.uint8), np.array([0, len(data)]), p.words)[1]
            return sets[x]

        for k, x in enumerate(zero.tolist()):
            others = one if len(one) else zero[k + 1 :]
            others = others[(now[others - s] != now[x - s]) & (node[others] != node[x])]
            stay, _ = survivors(sig, np.full(len(others), x), others, p, least)
            for at in range(0, len(stay), 512):
                to = others[stay[at : at + 512]]
                to = to[now[to - s] != now[x - s]]
                if not len(to):
                    continue
                own, each = shingles(x), [shingles(y) for y in to.tolist()]
                size = np.array([len(h) for h in each])
                found = np.concatenate([[0], np.cumsum(np.isin(np.concatenate(each), own, assume_unique=False))])
                end = np.cumsum(size)
                both = found[end] - found[end - size]
                ok = (both > 0) & (p.den * both >= p.num * (len(own) + size - both))
                for y in to[ok].tolist():
                    a, b = now[x - s], now[y - s]
                    if a != b and linked([open_.decompress(z[k]) if z[k] else b"" for k in (x, y)], p)[0]:
                        links.add((int(min(node[x], node[y])), int(max(node[x], node[y]))))
                        now[now == max(a, b)] = min(a, b)
    return links


def _matrix(column: pd.Series, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.uint8).reshape(-1, width)


def sketch(docs: DataFrame, p: MinHashParams) -> DataFrame:
    """``doc_id, size, a, b, sig, bands`` of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, at = rolling.buffers(batch.column(1))
            for i, j in rolling.groups_of(at, 2_000_000):
                n = j - i
                s = signatures(*shingle_sets(buf[at[i] : at[j]], at[i : j + 1] - at[i], p.words), n, p)
                sig = s["sig"].tobytes()
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(i, n).cast(pa.int64()),
                        pa.array(s["size"].astype(np.int64)),
                        pa.array(s["a"].view(np.int64)),
                        pa.array(s["b"].view(np.int64)),
                        pa.array([sig[k * p.hashes : (k + 1) * p.hashes] for k in range(n)], pa.binary()),
                        pa.ListArray.from_arrays(np.arange(n + 1, dtype=np.int32) * p.bands, pa.array(s["bands"].view(np.int64).ravel())),
                    ],
                    names=["doc_id", "size", "a", "b", "sig", "bands"],
                )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, size long, a long, b long, sig binary, bands array<long>")


def packed_texts(docs: DataFrame, ids: DataFrame, few: bool) -> DataFrame:
    """``node, z``: compressed texts of the documents in ``ids(node)``; few ids spare the texts a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        press = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            z = [press.compress((t or "").encode()) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(z, pa.binary())], names=["node", "z"])

    chosen = docs.select(F.col("doc_id").cast("long").alias("node"), "text").join(F.broadcast(ids) if few else ids, "node", "left_semi")
    return chosen.mapInArrow(run, "node long, z binary")


def verified(pairs: DataFrame, texts: DataFrame, p: MinHashParams) -> DataFrame:
    """The pairs ``a, b`` whose whole sets reach the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        open_ = zstandard.ZstdDecompressor()
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                data = [open_.decompress(z) if len(z) else b"" for c in (2, 3) for z in part.column(c).to_pylist()]
                ok = linked(data, p)
                yield pa.RecordBatch.from_arrays([part.column(0).filter(pa.array(ok)), part.column(1).filter(pa.array(ok))], names=["a", "b"])

    left = pairs.join(texts.select(F.col("node").alias("a"), F.col("z").alias("za")), "a")
    return left.join(texts.select(F.col("node").alias("b"), F.col("z").alias("zb")), "b").select("a", "b", "za", "zb").mapInArrow(run, "a long, b long")


def _spot(n, p: MinHashParams):
    """A node's tile among those that hold ``n`` nodes."""
    return (F.pmod(F.xxhash64("node"), F.lit(1 << 30)) % F.greatest(F.lit(1), F.ceil(n / F.lit(p.tile)))).cast("long")


def _to(n, p: MinHashParams):
    return F.sequence(F.lit(0).cast("long"), F.ceil(n / F.lit(p.tile)).cast("long") - 1)


def _dealt_join(members: DataFrame, about: DataFrame, key: str, p: MinHashParams) -> DataFrame:
    """``members`` joined with what ``about`` says of their key; the members of a large key are dealt out."""
    salt = F.pmod(F.xxhash64("node"), F.lit(p.salts)).cast("int").alias("salt")
    each = about.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(p.salts - 1))))
    return members.select("*", salt).join(each, [key, "salt"]).drop("salt")


def blocks(members: DataFrame, comps: DataFrame, p: MinHashParams) -> DataFrame:
    """Blocks ``block, side, node, comp`` in which every two documents of a bucket meet whose components differ.

    A document outside its bucket's largest component meets that component's members, tile by tile, once
    for all buckets; those outside meet each other within the bucket, tile by tile."""
    own = members.select("node").distinct().join(comps.withColumnRenamed("component", "comp"), "node", "left")
    own = own.select("node", F.coalesce("comp", "node").alias("comp"))
    joined = members.select("bucket", "node").join(own, "node")
    by = joined.groupBy("bucket", "comp").agg(F.count("*").alias("n"))
    shape = by.groupBy("bucket").agg(F.sum("n").alias("n"), F.max(F.struct("n", "comp")).alias("top"), F.count("*").alias("kinds")).where("kinds > 1")
    shape = shape.select("bucket", F.col("top.comp").alias("top"), (F.col("n") - F.col("top.n")).alias("n_rest"), (F.col("kinds") - 1).alias("kinds"))
    rest = cut(_dealt_join(joined, shape, "bucket", p).where("comp <> top"))

    guests = rest.select("node", "comp", "top").distinct()
    n_guests = guests.groupBy("top").agg(F.count("*").alias("g"))
    n_hosts = own.groupBy("comp").agg(F.count("*").alias("h")).withColumnRenamed("comp", "top")
    sizes = n_guests.join(n_hosts, "top")
    name = lambda *c: F.xxhash64(*c).alias("block")
    a = _dealt_join(guests, sizes, "top", p).withColumn("i", _spot(F.col("g"), p)).withColumn("j", F.explode(_to(F.col("h"), p)))
    b = _dealt_join(own.withColumn("top", F.col("comp")), sizes, "top", p).withColumn("j", _spot(F.col("h"), p)).withColumn("i", F.explode(_to(F.col("g"), p)))
    met = a.select(name(F.lit("host"), "top", "i", "j"), F.lit(0).alias("side"), "node", "comp")
    met = met.unionByName(b.select(name(F.lit("host"), "top", "i", "j"), F.lit(1).alias("side"), "node", "comp"))

    pairs = rest.where("kinds > 1").withColumn("spot", _spot(F.col("n_rest"), p)).withColumn("t", F.explode(_to(F.col("n_rest"), p)))
    low, high = F.least("t", "spot"), F.greatest("t", "spot")
    pairs = pairs.select(name(F.lit("rest"), "bucket", low, high), F.when(F.col("t") < F.col("spot"), 1).otherwise(0).alias("side"), "node", "comp")
    return met.unionByName(pairs)


def near_duplicates(docs: DataFrame, params: MinHashParams = MinHashParams()) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every row of ``docs``."""
    p = params
    rows = cut(sketch(docs, p))
    named = rows.where("size > 0 AND doc_id IS NOT NULL")
    classes = cut(named.groupBy("size", "a", "b").agg(F.min("doc_id").alias("node"), F.count("*").alias("n")))
    # Joined by id too, so a large class of copies isn't one key.
    reps = named.withColumnRenamed("doc_id", "node").join(classes.drop("n"), ["node", "size", "a", "b"], "left_semi")
    reps = cut(reps.select("node", "size", "a", "b", "sig", "bands").dropDuplicates(["node", "size", "a", "b"]))

    members = reps.select("node", F.explode("bands").alias("bucket"))
    found = members.groupBy("bucket").agg(F.count("*").alias("n"), F.min("node").alias("lo"), F.max("node").alias("hi"), *[F.sum(F.shiftright(F.xxhash64("node", F.lit(i)), 32)).alias(f"h{i}") for i in range(2)])
    alike = cut(found.where("n > 1").groupBy("n", "lo", "hi", "h0", "h1").agg(F.min("bucket").alias("bucket")))
    members = _dealt_join(members, alike.select("bucket", "n"), "bucket", p)
    sigs = reps.select("node", "sig")
    members = cut(members.join(sigs, "node").select("bucket", "n", "node", "sig"))

    total = members.count()
    parts = max(12, -(-total // p.part_rows))
    tile = F.pmod(F.xxhash64("node"), F.lit(1 << 30)) % F.ceil(F.col("n") / F.lit(p.tile))
    tiled = members.select(F.xxhash64("bucket", tile).alias("bucket"), "node", "sig")

    def trees(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["bucket", "node"], kind="stable")
        got = forest(pdf["bucket"].to_numpy(), pdf["node"].to_numpy(), _matrix(pdf["sig"], p.hashes), p)
        return pd.DataFrame(sorted(got), columns=["a", "b"], dtype="int64")

    def bridges(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["block", "side", "node"], kind="stable")
        key, node, comp, side = (pdf[c].to_numpy() for c in ("block", "node", "comp", "side"))
        got = crossing(key, node, comp, side, _matrix(pdf["sig"], p.hashes), pdf["z"].tolist(), p)
        return pd.DataFrame(sorted(got), columns=["a", "b"], dtype="int64")

    ids = cut(members.select("node").distinct())
    texts = cut(packed_texts(docs, ids, ids.count() <= p.few_ids))
    part = F.pmod(F.col("bucket"), F.lit(parts))
    pairs = cut(tiled.groupBy(part.alias("part")).applyInPandas(trees, "a long, b long").distinct())
    links = cut(verified(pairs, texts, p))
    comps = cut(components(links))
    met = cut(blocks(members, comps, p))
    kit = sigs.join(texts, "node")
    part = F.pmod(F.col("block"), F.lit(max(12, -(-met.count() // p.block_rows))))
    more = cut(met.join(kit, "node").groupBy(part.alias("part")).applyInPandas(bridges, "a long, b long").distinct())
    if not more.isEmpty():
        comps = cut(components(comps.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(more)))

    classes = cut(classes.join(comps, "node", "left").select("size", "a", "b", "n", F.coalesce("component", "node").alias("component")))
    # Classes of more than large members are broadcast, most_large at most by their sizes; the others meet their rows by shuffle.
    large = max(p.large_class, -(-rows.count() // p.most_large))
    own = classes.where(F.col("n") > large).select("size", "a", "b", F.col("component").alias("large"))
    ids = rows.select("doc_id", "size", "a", "b").join(F.broadcast(own), ["size", "a", "b"], "left")
    few = ids.where("large IS NULL").join(classes.where(F.col("n") <= large).drop("n"), ["size", "a", "b"], "left")
    out = few.drop("large").unionByName(ids.where("large IS NOT NULL").withColumnRenamed("large", "component"))
    comp = F.coalesce(F.when(F.col("doc_id").isNotNull(), F.col("component")), F.col("doc_id"))
    return out.select("doc_id", F.col("size").alias("n_shingles"), comp.alias("component_id"), F.col("doc_id").eqNullSafe(comp).alias("kept"))


def oracle(words: int, num: int, den: int) -> str:
    """Exact links and components in DuckDB SQL, by all pairs that share a shingle."""
    return f"""WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT doc_id, unnest(list_distinct(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < {words} THEN [array_to_string(ws, ' ')] ELSE list_transform(range(1, (len(ws) - {words - 2})::BIGINT), lambda i: array_to_string(ws[i:i + {words - 1}], ' ')) END)) AS sh FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.sh = y.sh AND x.doc_id < y.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE {den} * c >= {num} * (na.n + nb.n - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS v, doc_id AS c FROM documents UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.v),
k AS (SELECT v, min(c) AS c FROM r GROUP BY 1)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, k.c AS component_id, d.doc_id = k.c AS kept FROM documents d JOIN k ON k.v = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id"""
