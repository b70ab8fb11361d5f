"""Words of documents in one compact row each, counted in the task that splits the text, and what is read off such rows."""

from __future__ import annotations

import ctypes
import inspect
from array import array
from collections import Counter
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gleaner.functions.analysis import STOPWORDS
from gleaner.functions.porter import stem

#: treatment -> (stemmed, without stopwords), in this order.
TREATMENTS = {"stem_stop": (True, True), "nostem_stop": (False, True), "stem_nostop": (True, False), "nostem_nostop": (False, False)}
ROWS, BLOCK = 1024, 4096  # documents whose words are looked at together, in a batch and in norms

_RUNS = bytes(c if chr(c) in "abcdefghijklmnopqrstuvwxyz0123456789" else 32 for c in range(256))


def lean(make: Callable) -> Callable:
    """``make`` with Arrow's memory from the system, given back when it is done: a worker that waits for its next task holds little."""

    def give_back() -> None:
        ctypes.CDLL(None).malloc_trim(0)

    def batches(rows):
        pa.set_memory_pool(pa.system_memory_pool())
        try:
            yield from make(rows)
        finally:
            give_back()

    def table(*args):
        pa.set_memory_pool(pa.system_memory_pool())
        try:
            return make(*args)
        finally:
            give_back()

    if inspect.isgeneratorfunction(make):
        return batches
    return (lambda rows: table(rows)) if len(inspect.signature(make).parameters) == 1 else (lambda rows, more: table(rows, more))  # Spark counts parameters


def split(lowered: bytes) -> Counter:
    """Counts of ``analysis.tokens``: runs of a-z and 0-9 without a digit."""
    found = Counter(lowered.translate(_RUNS).split())
    for w in [w for w in found if not w.isalpha()]:
        del found[w]
    return found


def counted(docs: DataFrame, stopwords: Iterable[str] = STOPWORDS) -> DataFrame:
    """``doc_idx, n_all, n_kept, n_words, words, tfs``: lengths with and without stopwords, the text's words (each once,
    a space after each, stopwords last), ``n_words`` of which aren't stopwords, and their counts as 32-bit numbers."""
    stops = [w.encode() for w in dict.fromkeys(stopwords or ())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (b.slice(at, ROWS) for b in batches for at in range(0, b.num_rows, ROWS)):
            n_all, n_kept, n_words, words, tfs = [], [], [], [], []
            for text in b["text"].to_pylist():
                found = split(text)
                last = [(w, found.pop(w)) for w in stops if w in found]
                n_kept.append(sum(found.values()))
                n_words.append(len(found))
                found.update(dict(last))
                n_all.append(sum(found.values()))
                words.append(b" ".join([*found, b""]))
                tfs.append(array("i", found.values()).tobytes())
            columns = [b["doc_idx"], pa.array(n_all, pa.int64()), pa.array(n_kept, pa.int64()), pa.array(n_words, pa.int32()), pa.array(words, pa.binary()), pa.array(tfs, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_idx", "n_all", "n_kept", "n_words", "words", "tfs"])

    texts = docs.select("doc_idx", F.lower(F.coalesce("text", F.lit(""))).cast("binary").alias("text"))
    return texts.mapInArrow(lean(run), "doc_idx long, n_all long, n_kept long, n_words int, words binary, tfs binary")


class Flat:
    """The words of some rows of ``counted``, one below the other: ``row``, ``code`` (a place in ``terms``), ``tf``."""

    def __init__(self, rows: pa.RecordBatch | pa.Table):
        self.n = rows.num_rows
        self.doc_idx = rows["doc_idx"].to_numpy()
        data = b"".join(rows["words"].to_pylist())
        ends = np.flatnonzero(np.frombuffer(data, np.uint8) == 32) + 1
        offsets = np.concatenate([[0], ends]).astype(np.int32)
        found = pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(data)]).dictionary_encode()
        self.code = found.indices.to_numpy()
        self.terms = [w[:-1] for w in found.dictionary.to_pylist()]
        self.tf = np.frombuffer(b"".join(rows["tfs"].to_pylist()), np.int32)
        sizes = pc.binary_length(rows["tfs"]).to_numpy() // 4
        self.row = np.repeat(np.arange(self.n), sizes)
        place = np.arange(len(self.tf)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        self.kept = place < rows["n_words"].to_numpy()[self.row]
        self._stems: tuple[np.ndarray, list[bytes]] | None = None

    def treated(self, treatment: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes]]:
        """``row, code, tf, terms`` as a treatment has them, by row; a term is once in a row."""
        stemmed, stop = TREATMENTS[treatment]
        row, code, tf = (x[self.kept] for x in (self.row, self.code, self.tf)) if stop else (self.row, self.code, self.tf)
        if not stemmed:
            return row, code, tf, self.terms
        if self._stems is None:
            places: dict[str, int] = {}
            to = [places.setdefault(stem(w.decode()), len(places)) for w in self.terms]
            self._stems = np.array(to, np.int64), [w.encode() for w in places]
        to, stems = self._stems
        pairs, at = np.unique(row * len(stems) + to[code] if len(row) else np.zeros(0, np.int64), return_inverse=True)
        tf = np.bincount(at, weights=tf, minlength=len(pairs)).astype(np.int64)
        return pairs // max(1, len(stems)), pairs % max(1, len(stems)), tf, stems


def flats(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, Flat]]:
    for b in batches:
        for at in range(0, b.num_rows, ROWS):
            part = b.slice(at, ROWS)
            yield part, Flat(part)


def lengths(rows: pa.RecordBatch, treatment: str) -> np.ndarray:
    return rows["n_kept" if TREATMENTS[treatment][1] else "n_all"].to_numpy()


def postings(counted: DataFrame, treatments: Iterable[str]) -> DataFrame:
    """``treatment, term, doc_idx, tf, doc_len``."""
    wanted = list(treatments)

    def run(batches):
        for rows, flat in flats(batches):
            for t in wanted:
                row, code, tf, terms = flat.treated(t)
                name = pa.array(terms, pa.binary()).cast(pa.string()).take(pa.array(code))
                columns = [pa.array([t]).take(pa.array(np.zeros(len(row), np.int32))), name, pa.array(flat.doc_idx[row]), pa.array(tf.astype(np.int64)), pa.array(lengths(rows, t)[row])]
                yield pa.RecordBatch.from_arrays(columns, ["treatment", "term", "doc_idx", "tf", "doc_len"])

    return counted.mapInArrow(lean(run), "treatment string, term string, doc_idx long, tf long, doc_len long")


def term_stats(counted: DataFrame, treatments: Iterable[str]) -> DataFrame:
    """``treatment, term, df, cf``; words are added up in the task first, so a row per distinct word of thousands
    of documents crosses the network."""
    wanted = list(treatments)

    def run(batches):
        for _, flat in flats(batches):
            for t in wanted:
                _, code, tf, terms = flat.treated(t)
                df = np.bincount(code, minlength=len(terms))
                cf = np.bincount(code, weights=tf, minlength=len(terms)).astype(np.int64)
                has = np.flatnonzero(df)
                name = pa.array(terms, pa.binary()).cast(pa.string()).take(pa.array(has))
                columns = [pa.array([t]).take(pa.array(np.zeros(len(has), np.int32))), name, pa.array(df[has].astype(np.int64)), pa.array(cf[has])]
                yield pa.RecordBatch.from_arrays(columns, ["treatment", "term", "df", "cf"])

    parts = counted.mapInArrow(lean(run), "treatment string, term string, df long, cf long")
    return parts.groupBy("treatment", "term").agg(F.sum("df").alias("df"), F.sum("cf").alias("cf"))


def n_types(counted: DataFrame, treatments: Iterable[str]) -> DataFrame:
    """``treatment, n_types``: distinct words, and their distinct stems; each word is stemmed once."""

    def words(batches):
        for _, flat in flats(batches):
            kept = np.zeros(len(flat.terms), bool)
            kept[flat.code[flat.kept]] = True
            yield pa.RecordBatch.from_arrays([pa.array(flat.terms, pa.binary()).cast(pa.string()), pa.array(kept)], ["term", "kept"])

    def stems(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([stem(w) for w in b["term"].to_pylist()], pa.string()), b["kept"]], ["term", "kept"])

    vocabulary = counted.mapInArrow(lean(words), "term string, kept boolean").groupBy("term").agg(F.max("kept").alias("kept"))
    stemmed = vocabulary.mapInArrow(lean(stems), "term string, kept boolean").groupBy("term").agg(F.max("kept").alias("kept"))
    sizes = lambda df, s: df.agg(F.count("*").alias(f"{s}_nostop"), F.count_if("kept").alias(f"{s}_stop"))
    both = sizes(vocabulary, "nostem").crossJoin(sizes(stemmed, "stem"))  # one row each
    return both.select(F.inline(F.array(*[F.struct(F.lit(t).alias("treatment"), F.col(t).alias("n_types")) for t in treatments])))


def norms(counted: DataFrame, treatments: Iterable[str]) -> DataFrame:
    """``treatment, doc_idx, norm_raw, norm_log``: roots of the sums of squares of a document's tf-idf weights, over terms
    that some document lacks. Blocks of documents ask for the weight of each of their terms once, so a row per block and
    distinct term crosses the network and not one per posting; a block's documents and answers meet in one task."""
    wanted = list(treatments)
    blocks = counted.select(F.floor(F.col("doc_idx") / BLOCK).alias("block"), "doc_idx", "n_words", "words", "tfs")

    def ask(rows: pa.Table) -> pa.Table:
        flat, block, out = Flat(rows), rows["block"][0].as_py(), []
        for i, t in enumerate(wanted):
            _, code, _, terms = flat.treated(t)
            df = np.bincount(code, minlength=len(terms))
            has = np.flatnonzero(df)
            out.append(pa.table([pa.array(np.full(len(has), block)), pa.array(np.full(len(has), i, np.int32)), pa.array(terms, pa.binary()).take(pa.array(has)), pa.array(df[has].astype(np.int64))], ["block", "t", "term", "df"]))
        return pa.concat_tables(out)

    def answer(rows: pa.Table, stats: pa.Table) -> pa.Table:
        flat, out = (Flat(rows), []) if rows.num_rows else (None, [])
        for i, t in enumerate(wanted if flat else ()):
            row, code, tf, terms = flat.treated(t)
            own = stats.filter(pc.equal(stats["t"], i))
            at = pc.index_in(pa.array(terms, pa.binary()), value_set=own["term"].combine_chunks())
            found = at.is_valid().to_numpy(zero_copy_only=False)
            idf = np.zeros(len(terms))
            idf[found] = own["idf"].to_numpy()[at.drop_null().to_numpy()]
            c = idf[code]
            has = np.flatnonzero(np.bincount(row, weights=c > 0, minlength=flat.n))
            root = lambda w: np.sqrt(np.bincount(row, weights=w * w, minlength=flat.n))[has]  # noqa: B023, E731
            out.append(pa.table([pa.array([t] * len(has), pa.string()), pa.array(flat.doc_idx[has]), pa.array(root(tf * c)), pa.array(root((1.0 + np.log10(tf)) * c))], ["treatment", "doc_idx", "norm_raw", "norm_log"]))
        return pa.concat_tables(out) if out else pa.table({"treatment": pa.array([], pa.string()), "doc_idx": pa.array([], pa.int64()), "norm_raw": pa.array([], pa.float64()), "norm_log": pa.array([], pa.float64())})

    asked = blocks.groupBy("block").applyInArrow(lean(ask), "block long, t int, term binary, df long")
    total = F.sum("df").over(Window.partitionBy("t", "term"))  # a row per block
    n_docs = counted.agg(F.count("*").alias("n_docs"))
    stats = asked.select("block", "t", "term", total.alias("df")).crossJoin(F.broadcast(n_docs)).where("df < n_docs").select("block", "t", "term", F.log10(F.col("n_docs") / F.col("df")).alias("idf"))
    return blocks.groupBy("block").cogroup(stats.groupBy("block")).applyInArrow(lean(answer), "treatment string, doc_idx long, norm_raw double, norm_log double")


def gaps(counted: DataFrame, treatments: Iterable[str], span: int) -> DataFrame:
    """What ``index.gap_encode`` makes of the postings. Blocks of documents code their own part of each list, so a row per
    block and term crosses the network and no posting is sorted outside its block."""
    if span % BLOCK:
        raise ValueError(f"a span is a multiple of {BLOCK}")
    wanted = list(treatments)
    kinds = [("treatment", pa.string()), ("term", pa.string()), ("block", pa.int64()), ("start", pa.int64()), ("end", pa.int64()), ("rest", pa.list_(pa.int64()))]

    def code(rows: pa.Table) -> pa.Table:
        flat, out = Flat(rows), []
        for t in wanted:
            row, code, tf, terms = flat.treated(t)
            doc = flat.doc_idx[row]
            order = np.lexsort((doc, code))
            code, doc, tf = code[order], doc[order], tf[order]
            at = np.flatnonzero(np.diff(code, prepend=-1))  # where lists begin
            pairs = np.column_stack([np.diff(doc, prepend=0), tf]).astype(np.int64).reshape(-1)
            rest = np.delete(pairs, 2 * at)  # the first gap of a list depends on the block before
            offsets = np.append(2 * at - np.arange(len(at)), len(rest)).astype(np.int32)
            name = pa.array(terms, pa.binary()).cast(pa.string()).take(pa.array(code[at]))
            ends = doc[np.append(at[1:], len(doc)) - 1] if len(at) else doc
            columns = [pa.array([t] * len(at), pa.string()), name, pa.array(doc[at] // span), pa.array(doc[at]), pa.array(ends), pa.ListArray.from_arrays(pa.array(offsets), pa.array(rest))]
            out.append(pa.table(columns, schema=pa.schema(kinds)))
        return pa.concat_tables(out)

    blocks = counted.select(F.floor(F.col("doc_idx") / BLOCK).alias("part"), "doc_idx", "n_words", "words", "tfs")
    parts = blocks.groupBy("part").applyInArrow(lean(code), "treatment string, term string, block long, start long, end long, rest array<long>")
    lists = parts.groupBy("treatment", "term", "block").agg(F.array_sort(F.collect_list(F.struct("start", "end", "rest"))).alias("x"))  # span / BLOCK parts at most
    before = lambda i: F.when(i == 0, F.col("block") * span).otherwise(F.get(F.col("x"), i - 1)["end"])
    return lists.select("treatment", "term", "block", F.flatten(F.transform("x", lambda e, i: F.concat(F.array(e["start"] - before(i)), e["rest"]))).alias("gaps"))


def _hits(rows: pa.RecordBatch, flat: Flat, t: str, places: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    row, code, tf, terms = flat.treated(t)
    at = np.array([places.get(w, -1) for w in terms], np.int32)[code] if terms else np.zeros(0, np.int32)
    hit = at >= 0
    return row[hit], at[hit], tf[hit]


def matching(wanted: dict[str, list[str]]) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """What ``matches`` does with batches of ``counted``."""
    places = {t: {w.encode(): i for i, w in enumerate(terms)} for t, terms in wanted.items()}

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, flat in flats(batches):
            for t in places:
                row, ids, tf = _hits(rows, flat, t, places[t])
                n = np.bincount(row, minlength=flat.n)
                has = np.flatnonzero(n)
                ends = pa.array(np.concatenate([[0], np.cumsum(n[has])]).astype(np.int32))
                lists = [pa.ListArray.from_arrays(ends, pa.array(x.astype(np.int32))) for x in (ids, tf)]
                columns = [pa.array([t] * len(has), pa.string()), pa.array(flat.doc_idx[has]), pa.array(lengths(rows, t)[has]), *lists]
                yield pa.RecordBatch.from_arrays(columns, ["treatment", "doc_idx", "doc_len", "ids", "tfs"])

    return run


def matches(counted: DataFrame, wanted: dict[str, list[str]]) -> DataFrame:
    """``treatment, doc_idx, doc_len, ids, tfs``: which of a treatment's wanted terms (by place) a document holds, and
    how often; documents without any are left out."""
    return counted.mapInArrow(lean(matching(wanted)), "treatment string, doc_idx long, doc_len long, ids array<int>, tfs array<int>")


def document_counts(counted: DataFrame, wanted: dict[str, list[str]]) -> DataFrame:
    """``treatment, id, df`` of the wanted terms that some document holds."""
    places = {t: {w.encode(): i for i, w in enumerate(terms)} for t, terms in wanted.items()}

    def run(batches):
        df = {t: np.zeros(len(p), np.int64) for t, p in places.items()}
        for rows, flat in flats(batches):
            for t in places:
                df[t] += np.bincount(_hits(rows, flat, t, places[t])[1], minlength=len(places[t]))
        for t, n in df.items():
            has = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([t] * len(has), pa.string()), pa.array(has.astype(np.int32)), pa.array(n[has])], ["treatment", "id", "df"])

    return counted.mapInArrow(lean(run), "treatment string, id int, df long").groupBy("treatment", "id").agg(F.sum("df").alias("df"))
