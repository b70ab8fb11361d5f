"""The registered queries: each takes (spark, folder of tables). Unless a name says otherwise, texts
lose stopwords and aren't stemmed, so that SQL can follow."""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.functions import formats
from gleaner.functions.analysis import FIELDS, raw_tokens, tokens
from gleaner.functions.porter import stem_map
from gleaner.operators import evaluation, index, ranking, statistics, vocabulary, words
from gleaner.plans import experiments
from gleaner.sources import tables, trec

Query = Callable[[SparkSession, str], DataFrame]
PLAIN = "nostem_stop"
_found: dict[str, Query] = {}


def query(f: Query) -> Query:
    _found[f.__name__] = f
    return f


def queries() -> dict[str, Query]:
    return dict(_found)


def r6(*columns: str):
    return [F.round(c, 6).alias(c) for c in columns]


_kept: OrderedDict[tuple, tuple[object, Callable[[], None]]] = OrderedDict()
MOST_KEPT = 12  # tables or indexes; the one used longest ago goes first


def _keep(spark: SparkSession, sf: str, what: str, make: Callable[[], tuple[object, Callable[[], None]]]):
    """What several queries of a session read is computed once."""
    app = spark.sparkContext.applicationId
    for key in [k for k in _kept if k[0] != app]:
        del _kept[key]  # its session has ended
    key = (app, sf, what)
    if key not in _kept:
        _kept[key] = make()
    _kept.move_to_end(key)
    while len(_kept) > MOST_KEPT:
        _, (_, drop) = _kept.popitem(last=False)
        drop()
    return _kept[key][0]


def _table(spark: SparkSession, sf: str, what: str, make: Callable[[], DataFrame]) -> DataFrame:
    def kept():
        df = make().persist()
        return df, df.unpersist

    return _keep(spark, sf, what, kept)


def _docs(spark: SparkSession, sf: str) -> DataFrame:
    return _keep(spark, sf, "docs", lambda: (tables.documents(spark, sf), lambda: None))


def _counted(spark: SparkSession, sf: str) -> DataFrame:
    """Texts are split into words once for all indexes."""
    return _table(spark, sf, "words", lambda: words.counted(_docs(spark, sf)))


def _qrels(spark: SparkSession, sf: str) -> DataFrame:
    return _table(spark, sf, "qrels", lambda: tables.qrels(spark, sf))


def _index(spark: SparkSession, sf: str, *treatments: str) -> index.Index:
    def make():
        built = index.kept(_docs(spark, sf), treatments or (PLAIN,), counted=_counted(spark, sf))
        return built, lambda: index.release(built, counted=False)

    return _keep(spark, sf, "index " + " ".join(treatments or (PLAIN,)), make)


def _asked(spark: SparkSession, sf: str, *fields: str, treatment: str = PLAIN) -> DataFrame:
    return ranking.analysed_queries(tables.topics(spark, sf), fields or ("title",), (treatment,))


# Analysis


@query
def tokenize_counts(spark, sf):
    return _docs(spark, sf).select("docno", F.size(tokens(F.col("text"))).alias("n_tokens"))


@query
def raw_token_counts(spark, sf):
    return _docs(spark, sf).select("docno", F.size(raw_tokens(F.col("text"))).alias("n_tokens"))


@query
def vocab_funnel(spark, sf):
    return vocabulary.funnel(_docs(spark, sf), stemmed=False)


@query
def vocab_funnel_stemmed(spark, sf):
    return vocabulary.funnel(_docs(spark, sf))


@query
def stem_of_words(spark, sf):
    return stem_map(_index(spark, sf).term_stats.select("term"))


# Index


@query
def postings(spark, sf):
    return _index(spark, sf).postings.select("term", "doc_idx", "tf")


@query
def term_stats(spark, sf):
    return _index(spark, sf).term_stats.select("term", "df", "cf")


@query
def doc_stats(spark, sf):
    return _index(spark, sf).doc_stats.select("doc_idx", "doc_len")


@query
def collection_stats(spark, sf):
    return _index(spark, sf).collection.select("n_docs", "total_tokens", *r6("avgdl"))


@query
def stop_treatments(spark, sf):
    built = _index(spark, sf, "nostem_stop", "nostem_nostop")
    types = index.n_types(built)
    return built.collection.join(types, "treatment").select("treatment", "n_docs", "total_tokens", "n_types", *r6("avgdl"))


@query
def stem_treatments(spark, sf):
    built = _index(spark, sf, *index.TREATMENTS)
    types = index.n_types(built)
    return built.collection.join(types, "treatment").select("treatment", "n_docs", "total_tokens", "n_types", *r6("avgdl"))


@query
def idf_table(spark, sf):
    built = _index(spark, sf)
    rows = built.term_stats.join(F.broadcast(built.collection), "treatment")
    n, df = F.col("n_docs"), F.col("df")
    return rows.select("term", "df", F.round(ranking.idf_cosine(n, df), 6).alias("idf_cosine"), F.round(ranking.idf_bm25(n, df), 6).alias("idf_bm25"))


@query
def doc_norms(spark, sf):
    return _index(spark, sf).norms.select("doc_idx", *r6("norm_raw", "norm_log"))


@query
def gap_encode(spark, sf):
    return index.coded(_index(spark, sf), [PLAIN]).select("term", "block", F.array_join("gaps", ",").alias("gaps"))


@query
def gap_roundtrip(spark, sf):
    return index.gap_decode(index.coded(_index(spark, sf), [PLAIN])).select("term", "doc_idx", "tf")


@query
def forward_index(spark, sf):
    rows = index.forward(_index(spark, sf).postings)
    return rows.select("doc_idx", F.array_join(F.transform("terms", lambda e: F.concat_ws(":", e["term"], e["tf"].cast("string"))), " ").alias("terms"))


# Queries and ranking


@query
def query_terms(spark, sf):
    known = ranking.known_terms(_asked(spark, sf, *FIELDS), _index(spark, sf))
    return known.select("num", "field", "term", "qtf", "first_pos", "df")


@query
def query_unknown_terms(spark, sf):
    return ranking.unknown_terms(_asked(spark, sf, *FIELDS), _index(spark, sf)).select("num", "field", "term", "qtf", "first_pos")


def _top10(spark, sf, ranker: str, field: str) -> DataFrame:
    rows = ranking.run(tables.topics(spark, sf), _index(spark, sf), (field,), (ranker,), (PLAIN,), top_n=10)
    return rows.select("num", "rank", "docno", *r6("score"))


for _r in ranking.RANKERS:
    for _f in FIELDS:
        _found[f"{_r}_{_f}_top10"] = lambda spark, sf, r=_r, f=_f: _top10(spark, sf, r, f)


def _explained(spark, sf, ranker: str) -> DataFrame:
    built, asked = _index(spark, sf), _asked(spark, sf)
    hits = ranking.best(asked, built, [("bm25", ranking.K1, ranking.B) if ranker == "bm25" else (ranker,)], 3)
    return ranking.explained(asked, built, ranker, hits).select("num", "doc_idx", "first_pos", "term", "qtf", "tf", "df", *r6("idf", "contribution"))


@query
def explain_bm25(spark, sf):
    return _explained(spark, sf, "bm25")


@query
def explain_tfidf_raw(spark, sf):
    return _explained(spark, sf, "tfidf_raw")


@query
def explain_tfidf_log(spark, sf):
    return _explained(spark, sf, "tfidf_log")


@query
def search_single_query(spark, sf):
    topic = spark.createDataFrame([(0, "the ingand of thand erhe")], "num int, title string")
    rows = ranking.run(topic, _index(spark, sf), ("title",), ("bm25",), (PLAIN,), top_n=10)
    return rows.select("rank", "docno", *r6("score"))


@query
def bm25_stemmed_top10(spark, sf):
    rows = ranking.run(tables.topics(spark, sf), _index(spark, sf, "stem_stop"), ("title",), ("bm25",), ("stem_stop",), top_n=10)
    return rows.select("num", "rank", "docno", *r6("score"))


# Evaluation


def _main(spark, sf, treatment: str = PLAIN) -> DataFrame:
    """The nine runs by topic: a few hundred rows that many queries read."""
    make = lambda: experiments.main_runs(tables.topics(spark, sf), _index(spark, sf, treatment), _qrels(spark, sf), treatment)
    return _table(spark, sf, f"runs {treatment}", make)


def _treated(spark, sf) -> DataFrame:
    make = lambda: experiments.treatment_runs(tables.topics(spark, sf), _index(spark, sf, *index.TREATMENTS), _qrels(spark, sf))
    return _table(spark, sf, "treated", make)


def _grid(spark, sf) -> DataFrame:
    return _table(spark, sf, "grid", lambda: experiments.grid(tables.topics(spark, sf), _index(spark, sf), _qrels(spark, sf), PLAIN))


def _bm25(spark, sf) -> DataFrame:
    return _main(spark, sf).where("run_key = 'bm25|title'")


@query
def qrels(spark, sf):
    return tables.qrels(spark, sf)


@query
def eval_topics(spark, sf):
    return evaluation.eval_topics(_qrels(spark, sf))


@query
def qrels_counts(spark, sf):
    return evaluation.qrels_counts(_qrels(spark, sf))


@query
def metrics_per_topic(spark, sf):
    return _bm25(spark, sf).select("num", "n_rel", "n_judged", *r6(*evaluation.METRICS))


@query
def metrics_per_topic_all_runs(spark, sf):
    return _main(spark, sf).select("run_key", "num", *r6(*evaluation.METRICS))


@query
def map_by_run(spark, sf):
    return evaluation.means(_main(spark, sf), ["run_key"]).select("run_key", "n_topics", *r6("map", *evaluation.METRICS[1:]))


@query
def interp_curve(spark, sf):
    return evaluation.mean_curve(_bm25(spark, sf), ["ranker", "field"]).select("level", *r6("precision"))


@query
def paired_wins(spark, sf):
    rows = _main(spark, sf)
    side = lambda k: rows.where(F.col("run_key") == k)
    rows = statistics.paired(side("bm25|title"), side("tfidf_raw|title"), [])
    return rows.select(*r6("mean_diff"), "wins", "losses", "ties")


@query
def best_run(spark, sf):
    return experiments.topic_table(_main(spark, sf), tables.topics(spark, sf)).select("num", "title", "n_rel", "n_judged", "best_run", *r6("best_ap"))


@query
def ap_by_run(spark, sf):
    rows = experiments.ap_by_run(_main(spark, sf))
    return rows.select("run_key", F.posexplode("ap").alias("place", "ap")).select("run_key", "place", *r6("ap"))


@query
def zero_counts(spark, sf):
    return experiments.zero_counts(_main(spark, sf)).select("run_key", "n_zero", "n_below_01", "n_above_09", *r6("median_ap"))


@query
def bm25_grid(spark, sf):
    return _grid(spark, sf).select("k1", "b", *r6("map"))


@query
def bm25_grid_best(spark, sf):
    return experiments.best_cell(_grid(spark, sf)).select("k1", "b", *r6("map"))


@query
def bootstrap_map(spark, sf):
    return experiments.summaries(_bm25(spark, sf), ["ranker", "field"]).select("ranker", "field", "metric", *r6("mean", "lo", "hi"))


@query
def treatment_table(spark, sf):
    rows = experiments.treatment_table(_treated(spark, sf), _index(spark, sf, *index.TREATMENTS))
    return rows.select("treatment", "n_types", "metric", *r6("mean", "lo", "hi"))


@query
def treatment_means(spark, sf):
    return _treated(spark, sf).groupBy("treatment").agg(F.round(F.avg("ap"), 6).alias("map"), F.round(F.avg("p10"), 6).alias("p10"))


@query
def paired_counts(spark, sf):
    rows = experiments.comparisons(_main(spark, sf, "stem_stop"), _treated(spark, sf), intervals=False)
    return rows.select("key", "label", *r6("mean_diff"), "wins", "losses", "ties")


@query
def bootstrap_sample(spark, sf):
    rows = spark.createDataFrame([(k, i, x) for k, v in experiments.SAMPLE for i, x in enumerate(v)], "name string, num int, value double")
    return statistics.bootstrap(rows, ["name"]).select("name", *r6("mean", "lo", "hi"))


@query
def paired_comparisons(spark, sf):
    rows = experiments.comparisons(_main(spark, sf, "stem_stop"), _treated(spark, sf))
    return rows.select("key", "label", *r6("mean_diff", "lo", "hi"), "wins", "losses", "ties")


# Vocabulary


@query
def heaps_points(spark, sf):
    return vocabulary.heaps_points(_docs(spark, sf), lengths=_index(spark, sf).doc_stats)


@query
def heaps_fit(spark, sf):
    return vocabulary.heaps_fit(vocabulary.heaps_points(_docs(spark, sf), lengths=_index(spark, sf).doc_stats)).select(*r6("k", "beta"))


@query
def ranked_terms(spark, sf):
    return vocabulary.ranked_terms(_index(spark, sf).term_stats)


@query
def zipf_points(spark, sf):
    return vocabulary.zipf_points(_index(spark, sf).term_stats)


@query
def zipf_fit(spark, sf):
    return vocabulary.zipf_fit(_index(spark, sf).term_stats).select(*r6("slope", "intercept"))


@query
def top_terms(spark, sf):
    return vocabulary.top_terms(_index(spark, sf).term_stats)


@query
def longest_postings(spark, sf):
    return vocabulary.longest_postings(_index(spark, sf).term_stats)


@query
def stem_groups(spark, sf):
    built = _index(spark, sf, "nostem_stop", "stem_stop")
    pick = lambda t: built.term_stats.where(F.col("treatment") == t)
    return vocabulary.stem_groups(pick("nostem_stop"), pick("stem_stop"))


@query
def posting_hist(spark, sf):
    return statistics.histogram(_index(spark, sf).term_stats, "df", statistics.POSTING_BINS)


@query
def posting_summary(spark, sf):
    return vocabulary.posting_summary(_index(spark, sf).term_stats).select("n_terms", "n_postings", *r6("mean_len", "median_len"), "max_len", *r6("df1_share"))


@query
def doc_len_hist(spark, sf):
    return statistics.histogram(_index(spark, sf).doc_stats, "doc_len", statistics.DOC_LEN_BINS)


@query
def doc_len_summary(spark, sf):
    return vocabulary.doc_len_summary(_index(spark, sf).doc_stats).select(*r6("mean", "median", "p10", "p90"), "max")


@query
def corpus_summary(spark, sf):
    return vocabulary.corpus_summary(_docs(spark, sf))


@query
def funnel_drops(spark, sf):
    rows = vocabulary.funnel_drops(vocabulary.funnel(_docs(spark, sf), stemmed=False))
    return rows.select("step", *r6("kept_tokens", "kept_types"), "largest_drop")


@query
def zipf_verdict(spark, sf):
    return vocabulary.zipf_verdict(vocabulary.zipf_fit(_index(spark, sf).term_stats)).select(*r6("slope", "intercept"), "verdict")


@query
def doc_len_hist_trimmed(spark, sf):
    return vocabulary.trimmed(statistics.histogram(_index(spark, sf).doc_stats, "doc_len", statistics.DOC_LEN_BINS))


@query
def heaps_residual(spark, sf):
    return vocabulary.heaps_residual(vocabulary.heaps_points(_docs(spark, sf), lengths=_index(spark, sf).doc_stats)).select(*r6("residual"))


@query
def zipf_fitted(spark, sf):
    terms = _index(spark, sf).term_stats
    return vocabulary.zipf_fitted(vocabulary.zipf_points(terms), vocabulary.zipf_fit(terms)).select("rank", "term", "cf", *r6("fitted"))


@query
def sorted_differences(spark, sf):
    pairs = experiments.comparisons(_main(spark, sf, "stem_stop"), _treated(spark, sf), intervals=False)
    return experiments.sorted_differences(pairs).select("key", "place", *r6("diff"))


@query
def formatted_measures(spark, sf):
    rows = _bm25(spark, sf).agg(F.avg("ap").alias("ap"), F.avg("p10").alias("p10"), F.sum("n_judged").alias("n"))
    return rows.select(formats.whole(F.col("n")).alias("n_judged"), formats.score(F.round("ap", 6)).alias("map"), formats.percent(F.round("p10", 6)).alias("p10"), formats.signed(F.round(-F.col("ap"), 6)).alias("loss"))


@query
def dead_topics(spark, sf):
    return experiments.dead_topics(_main(spark, sf))


@query
def grid_swing(spark, sf):
    return experiments.grid_swing(_grid(spark, sf)).select(*r6("worst", "best", "swing"))


# Readers, on literal files

SGML = """<DOC><DOCNO> X-10 </DOCNO><DATE>911231</DATE><HEADLINE>FT  31 DEC 91 / Caf&eacute;  and
 more</HEADLINE><TEXT> One &amp; two. </TEXT><TEXT>Three.</TEXT></DOC>
<DOC><DOCNO>X-9</DOCNO><DATE>050102</DATE><TEXT>No headline.</TEXT></DOC>"""
TOPICS = """<top>
<num> Number: 7
<title> jet   engine
<desc> Description:
Documents about jets.
<narr> Narrative:
Any jet.
</top>
<top><num>3</num><title>bank money</title><desc>About banks.</desc><narr>Any bank.</narr></top>"""
QRELS = "7 0 X-9 0\n7 0 X-10 2\n\n3 0 X-9 1\n7 0 X-9 1\n"


@query
def sgml_parse(spark, sf):
    docs = trec.parse_sgml(spark.createDataFrame([(SGML,)], "value string"))
    return trec.with_positions(docs, F.element_at(F.split("docno", "-"), 2)).select("doc_idx", "docno", "date", "headline", "text")


@query
def topic_parse(spark, sf):
    return trec.parse_topics(spark.createDataFrame([(TOPICS,)], "value string"))


@query
def qrels_parse(spark, sf):
    lines = spark.createDataFrame([(QRELS,)], "value string").select(F.posexplode(F.split("value", "\n")).alias("line_no", "value"))
    return trec.parse_qrels(lines)
