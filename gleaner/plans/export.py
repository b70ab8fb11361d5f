"""Files from small results: JSON with a size cap, deterministic gzip, the search index, contract objects.

What is collected here is a report (rows per run, topic or bin) or, for the search index, the file a
browser loads; large indexes stay tables.
"""

from __future__ import annotations

import datetime
import gzip
import io
import json
import shutil
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.operators import evaluation, index, ranking, vocabulary
from gleaner.plans import experiments

LIMIT = 200_000


def round6(x: float) -> float:
    return round(float(x), 6)


def now() -> str:
    return datetime.datetime.now(datetime.UTC).replace(microsecond=0).isoformat()


def write_json(path: Path, value, limit: int = LIMIT) -> int:
    """Indented UTF-8 JSON with line feeds; NaN and files over ``limit`` bytes are errors. Returns the size."""
    data = (json.dumps(value, indent=1, ensure_ascii=False, allow_nan=False) + "\n").encode()
    if len(data) > limit:
        raise ValueError(f"{Path(path).name} has {len(data)} bytes; the limit is {limit}")
    Path(path).write_bytes(data)
    return len(data)


def gzip_json(value) -> bytes:
    """Compact JSON, gzipped without name or time: equal values give equal bytes."""
    data = json.dumps(value, separators=(",", ":"), ensure_ascii=False, allow_nan=False).encode()
    out = io.BytesIO()
    with gzip.GzipFile(filename="", mode="wb", compresslevel=9, fileobj=out, mtime=0) as f:
        f.write(data)
    return out.getvalue()


def contract(name: str, **fields) -> dict:
    return {"schema": f"{name}.v1", "generated_at": now(), **fields}


def rows(df: DataFrame, *order: str) -> list[dict]:
    """A small result in a fixed order; doubles to six places."""
    tidy = lambda v: round6(v) if isinstance(v, float) else [tidy(x) for x in v] if isinstance(v, list) else v.isoformat() if isinstance(v, datetime.date) else v
    return [{k: tidy(v) for k, v in r.asDict(recursive=True).items()} for r in df.orderBy(*order).collect()]


def check_order(built: index.Index, docs: DataFrame) -> None:
    """Documents and index must place the same docnos alike."""
    a, b = built.docs.select("doc_idx", "docno"), docs.select("doc_idx", "docno")
    if not a.exceptAll(b).isEmpty() or not b.exceptAll(a).isEmpty():
        raise ValueError("documents and index disagree about the documents' order")


def search_index(built: index.Index, docs: DataFrame, treatment: str = "stem_stop", most_docs: int = 1_000_000) -> dict:
    """The one file that a browser loads: document names and lengths, gap-coded postings by term; never texts.
    A collection of more documents than a browser can hold is refused; ``write_index`` takes any."""
    check_order(built, docs)
    built = vocabulary.one(built, treatment)
    collection = built.collection.first()
    if collection["n_docs"] > most_docs:
        raise ValueError(f"{collection['n_docs']} documents are too many for one file; write_index writes tables")
    date = F.col("date").cast("string") if "date" in docs.columns else F.lit("")
    names = docs.select("doc_idx", "docno", date.alias("d"), "headline").orderBy("doc_idx").collect()
    coded = index.gap_encode(built.postings, span=most_docs)  # one block
    return {
        "schema": "search_index.v1", "n_docs": collection["n_docs"], "avgdl": round6(collection["avgdl"]), "k1": ranking.K1, "b": ranking.B,
        "docs": [{"no": r["docno"], "d": r["d"], "h": r["headline"]} for r in names],
        "doc_len": [r["doc_len"] for r in built.doc_stats.orderBy("doc_idx").collect()],
        "terms": {r["term"]: list(r["gaps"]) for r in coded.orderBy("term").collect()},
    }


def read_search_index(spark: SparkSession, data: bytes, treatment: str = "stem_stop") -> index.Index:
    """A search index of one file, gzipped or not, as the tables that rank."""
    raw = gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data
    found = json.loads(raw)
    if found.get("schema") != "search_index.v1":
        raise ValueError(f"not a search index: {found.get('schema')!r}")
    docs = [(i, d["no"], d["d"], d["h"], n) for i, (d, n) in enumerate(zip(found["docs"], found["doc_len"], strict=True))]
    docs = spark.createDataFrame(docs, "doc_idx long, docno string, date string, headline string, doc_len long")
    coded = spark.createDataFrame([(treatment, t, 0, g) for t, g in found["terms"].items()], "treatment string, term string, block long, gaps array<long>")
    postings = index.gap_decode(coded).join(docs.select("doc_idx", "doc_len"), "doc_idx")
    return index.tables(docs.drop("doc_len"), [treatment], postings.select("treatment", "term", "doc_idx", "tf", "doc_len"))


def write_index(built: index.Index, path: str) -> None:
    """An index of any size as tables of gap-coded blocks; nothing passes the driver."""
    index.gap_encode(built.postings).write.parquet(f"{path}/blocks")
    built.docs.drop("text").write.parquet(f"{path}/docs")
    built.doc_stats.write.parquet(f"{path}/doc_stats")


def read_index(spark: SparkSession, path: str) -> index.Index:
    """What ``write_index`` wrote."""
    blocks, docs, lengths = (spark.read.parquet(f"{path}/{n}") for n in ("blocks", "docs", "doc_stats"))
    postings = index.gap_decode(blocks).join(lengths, ["treatment", "doc_idx"]).select("treatment", "term", "doc_idx", "tf", "doc_len")
    return index.tables(docs, [r["treatment"] for r in lengths.select("treatment").distinct().collect()], postings)


def write_course_text(built: index.Index, path: str, inverted: bool = True) -> None:
    """An index as lines of text, ``key: k: v; k: v``: documents of a term, or terms of a document."""
    pair = F.struct("doc_idx", "docno", "tf") if inverted else F.struct(F.col("term").alias("doc_idx"), F.col("term").alias("docno"), "tf")
    rows = built.postings.join(built.docs.select("doc_idx", "docno"), "doc_idx")
    lists = rows.groupBy("term" if inverted else "docno").agg(F.array_sort(F.collect_list(pair)).alias("x"))
    body = F.array_join(F.transform("x", lambda e: F.concat_ws(": ", e["docno"], e["tf"].cast("string"))), "; ")
    lists.select(F.concat_ws(": ", F.col("term" if inverted else "docno"), body).alias("value")).write.text(path)


def read_course_text(spark: SparkSession, path: str) -> DataFrame:
    """``key, item, tf`` of such lines."""
    line = spark.read.text(path).where("value <> ''").select(F.regexp_extract("value", r"^(.*?): (.*)$", 1).alias("key"), F.explode(F.split(F.regexp_extract("value", r"^(.*?): (.*)$", 2), "; ")).alias("p"))
    return line.select("key", F.regexp_extract("p", r"^(.*): (\d+)$", 1).alias("item"), F.regexp_extract("p", r"^(.*): (\d+)$", 2).cast("long").alias("tf"))


def golden(topics: DataFrame, built: index.Index, ranker: str, treatment: str = "stem_stop") -> dict:
    """Ten best documents of each topic that has hits, by title."""
    found = ranking.run(topics, built, ("title",), (ranker,), (treatment,), top_n=10).orderBy("num", "rank").collect()
    out: dict[str, list] = {}
    for r in found:
        out.setdefault(str(r["num"]), []).append({"no": r["docno"], "score": round6(r["score"])})
    return out


def reports(docs: DataFrame, topics: DataFrame, qrels: DataFrame, stopwords) -> dict[str, dict]:
    """The contract objects of a full build, computed before anything is written."""
    built = index.kept(docs, stopwords=stopwords)
    main = experiments.main_runs(topics, built, qrels, stopwords=stopwords).cache()
    treated = experiments.treatment_runs(topics, built, qrels, stopwords=stopwords).cache()
    stem, plain = vocabulary.one(built, "stem_stop"), vocabulary.one(built, "nostem_stop")
    heaps = vocabulary.heaps_points(docs, stopwords).cache()
    cells = experiments.grid(topics, built, qrels, stopwords=stopwords).cache()
    from gleaner.operators import statistics

    return {
        "corpus": contract("corpus", **rows(vocabulary.corpus_summary(docs), "n_docs")[0], doc_len_hist=rows(statistics.histogram(stem.doc_stats, "doc_len", statistics.DOC_LEN_BINS), "bin"), doc_len_summary=rows(vocabulary.doc_len_summary(stem.doc_stats), "max")[0]),
        "vocab": contract("vocab", funnel=rows(vocabulary.funnel(docs, stopwords), F.desc("n_tokens"), F.desc("n_types")), heaps=rows(heaps, "n_tokens"), heaps_fit=rows(vocabulary.heaps_fit(heaps), "k")[0], zipf=rows(vocabulary.zipf_points(plain.term_stats), "rank"), zipf_fit=rows(vocabulary.zipf_fit(plain.term_stats), "slope")[0], top_terms=rows(vocabulary.top_terms(plain.term_stats), F.desc("cf"), "term"), stem_groups=rows(vocabulary.stem_groups(plain.term_stats, stem.term_stats), F.desc("n_words"), F.desc("stem_cf"), "stem", "place")),
        "postings": contract("postings", hist=rows(statistics.histogram(stem.term_stats, "df", statistics.POSTING_BINS), "bin"), summary=rows(vocabulary.posting_summary(stem.term_stats), "n_terms")[0], longest=rows(vocabulary.longest_postings(stem.term_stats), F.desc("df"), "term")),
        "runs": contract("runs", **rows(evaluation.qrels_counts(qrels), "n_topics")[0], runs=rows(experiments.summaries(main, ["run_order", "run_key"]), "run_order", "metric")),
        "per_topic": contract("per_topic", ap=rows(experiments.ap_by_run(main), "run_key")),
        "comparisons": contract("comparisons", pairs=rows(experiments.comparisons(main, treated), "place")),
        "pr_curves": contract("pr_curves", curves=rows(evaluation.mean_curve(main, ["run_key"]), "run_key", "level")),
        "topics": contract("topics", topics=rows(experiments.topic_table(main, topics), "num")),
        "bm25_grid": contract("bm25_grid", cells=rows(cells, "k1", "b"), best=rows(experiments.best_cell(cells), "k1")[0]),
        "treatments": contract("treatments", rows=rows(experiments.treatment_table(treated, built), "treatment", "metric")),
    }


def claims(values: dict) -> dict:
    """Single numbers quoted from reports; a missing one is an error."""
    missing = [k for k, v in values.items() if v is None]
    if missing:
        raise ValueError(f"claims lack values for {', '.join(missing)}")
    return contract("claims", values=values)


def write_reports(out: Path, found: dict[str, dict]) -> dict[str, int]:
    """Replace the folder's files by the reports; called once all are computed."""
    out = Path(out)
    if out.exists():
        shutil.rmtree(out)
    out.mkdir(parents=True)
    return {f"{name}.json": write_json(out / f"{name}.json", value) for name, value in found.items()}


def write_stopwords(path: Path, stopwords) -> int:
    return write_json(path, sorted(set(stopwords)))
