"""DuckDB SQL for the registered queries."""

from __future__ import annotations

import numpy as np

from gleaner.functions import porter
from gleaner.functions.analysis import FIELDS, STOPWORDS
from gleaner.operators.index import TREATMENTS
from gleaner.operators.ranking import B, K1, RANKERS, TOP_N
from gleaner.operators.statistics import DOC_LEN_BINS, N_BOOT, POSTING_BINS, SEED
from gleaner.plans.experiments import GRID_B, GRID_K1, PAIRS, SAMPLE, pair_label


def _list(items) -> str:
    return "[" + ", ".join(f"'{x}'" if isinstance(x, str) else str(x) for x in items) + "]"


def _words(text: str) -> str:
    return f"list_filter(regexp_extract_all(lower(coalesce({text}, '')), '[a-z0-9]+'), lambda x: NOT regexp_matches(x, '[0-9]'))"


PARTS = {
    "stops": f"SELECT unnest({_list(STOPWORDS)}) AS w",
    "docs": "SELECT row_number() OVER (ORDER BY doc_id) - 1 AS doc_idx, 'D' || doc_id AS docno, text FROM documents",
    "words": f"SELECT doc_idx, {_words('text')} AS l FROM docs",
    "tok": "SELECT doc_idx, unnest(l) AS term, generate_subscripts(l, 1) - 1 AS pos FROM words",
    "kept": "SELECT * FROM tok WHERE term NOT IN (SELECT w FROM stops)",
    "po": "SELECT term, doc_idx, count(*) AS tf FROM kept GROUP BY ALL",
    "ds": "SELECT d.doc_idx, coalesce(sum(p.tf), 0)::BIGINT AS doc_len FROM docs d LEFT JOIN po p USING (doc_idx) GROUP BY 1",
    "ts": "SELECT term, count(*) AS df, sum(tf)::BIGINT AS cf FROM po GROUP BY 1",
    "cs": "SELECT count(*) AS n_docs, sum(doc_len)::BIGINT AS total_tokens, avg(doc_len) AS avgdl FROM ds",
    "tp": "SELECT item_id AS num, string_split(text, '. ') AS p FROM benchmark",
    "topics": "SELECT num, coalesce(p[1], '') AS title, coalesce(p[2], '') AS \"desc\", coalesce(array_to_string(p[3:], ' '), '') AS narr FROM tp",
    "fields": " UNION ALL ".join(f"SELECT num, '{f}' AS field, concat_ws(' ', " + ", ".join(f'"{c}"' for c in cols) + ") AS q FROM topics" for f, cols in FIELDS.items()),
    "ql": f"SELECT num, field, list_filter({_words('q')}, lambda x: NOT list_contains({_list(STOPWORDS)}, x)) AS l FROM fields",
    "qw": "SELECT num, field, unnest(l) AS term, generate_subscripts(l, 1) - 1 AS pos FROM ql",
    "qt": "SELECT num, field, term, count(*) AS qtf, min(pos) AS first_pos FROM qw GROUP BY ALL",
    "kt": "SELECT qt.*, ts.df, ts.cf, cs.* FROM qt JOIN ts USING (term) CROSS JOIN cs",
    "idf": "SELECT term, df, log10(n_docs::DOUBLE / df) AS c, ln((n_docs - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE) + 1) AS i FROM ts CROSS JOIN cs",
    "norms": "SELECT doc_idx, sqrt(sum((tf * c) ** 2)) AS norm_raw, sqrt(sum(((1 + log10(tf)) * c) ** 2)) AS norm_log FROM po JOIN idf USING (term) WHERE c > 0 GROUP BY 1",
    "qn": "SELECT num, field, sqrt(sum((qtf * c) ** 2)) AS q_raw, sqrt(sum(((1 + log10(qtf)) * c) ** 2)) AS q_log FROM qt JOIN idf USING (term) GROUP BY ALL",
    "con": f"""SELECT qt.num, qt.field, qt.term, qt.qtf, qt.first_pos, po.doc_idx, po.tf, idf.df, idf.c, idf.i, ds.doc_len, cs.avgdl,
  qtf * c * tf * c AS c_tfidf_raw, (1 + log10(qtf)) * c * (1 + log10(tf)) * c AS c_tfidf_log,
  qtf * i * (tf * {K1 + 1}::DOUBLE / (tf + {K1}::DOUBLE * ({1 - B}::DOUBLE + {B}::DOUBLE * doc_len / avgdl))) AS c_bm25
  FROM qt JOIN idf USING (term) JOIN po USING (term) JOIN ds USING (doc_idx) CROSS JOIN cs""",
    "sums": "SELECT num, field, doc_idx, sum(c_tfidf_raw) AS r, sum(c_tfidf_log) AS l, sum(c_bm25) AS bm FROM con GROUP BY ALL",
    "sc": """SELECT * FROM (SELECT num, field, doc_idx, unnest(['tfidf_raw', 'tfidf_log', 'bm25']) AS ranker,
  unnest([CASE WHEN norm_raw * q_raw > 0 THEN r / (norm_raw * q_raw) END, CASE WHEN norm_log * q_log > 0 THEN l / (norm_log * q_log) END, bm]) AS score
  FROM sums LEFT JOIN norms USING (doc_idx) LEFT JOIN qn USING (num, field)) WHERE score > 0""",
    "run": f"SELECT * FROM (SELECT sc.*, docno, row_number() OVER (PARTITION BY num, field, ranker ORDER BY round(score, 9) DESC, doc_idx) AS rank FROM sc JOIN docs USING (doc_idx)) WHERE rank <= {TOP_N}",
    "pw": f"SELECT DISTINCT num, term FROM (SELECT item_id AS num, unnest(l[2:len(l) - 1]) AS term FROM (SELECT item_id, {_words('text')} AS l FROM benchmark))",
    "wd": "SELECT term, count(DISTINCT doc_idx) AS df FROM tok GROUP BY 1",
    "rare": "SELECT num, term FROM (SELECT *, row_number() OVER (PARTITION BY num ORDER BY df, term) AS k FROM pw JOIN wd USING (term)) WHERE k = 1",
    "qrels": "SELECT num, docno, contains(docs.text, benchmark.text)::INTEGER AS rel FROM (SELECT DISTINCT num, doc_idx FROM rare JOIN tok USING (term)) JOIN docs USING (doc_idx) JOIN benchmark ON item_id = num",
    "et": "SELECT num, sum(rel)::BIGINT AS n_rel, count(*) AS n_judged FROM qrels GROUP BY 1 HAVING sum(rel) > 0",
    "hits": """SELECT run.ranker, run.field, run.num, rank, coalesce(rel, 0) AS r, (rel IS NOT NULL)::INT AS j, n_rel,
  sum(coalesce(rel, 0)) OVER (PARTITION BY run.ranker, run.field, run.num ORDER BY rank) AS h FROM run JOIN et USING (num) LEFT JOIN qrels USING (num, docno)""",
    "got": "SELECT ranker, field, num, sum(r * h / rank) / max(n_rel) AS ap, sum(r) FILTER (rank <= 10) / 10 AS p10, sum(r / log2(rank + 1)) FILTER (rank <= 10) AS dcg, sum(r) FILTER (rank <= n_rel) / max(n_rel) AS rprec, sum(r) FILTER (rank <= 100) / max(n_rel) AS recall100, sum(j) FILTER (rank <= 10) / 10 AS judged10, "
    + ", ".join(f"coalesce(max(h / rank) FILTER (r = 1 AND h * 10 >= n_rel * {i}), 0) AS i{i}" for i in range(11))
    + " FROM hits GROUP BY ALL",
    "keys": "SELECT DISTINCT ranker, field FROM run",
    "pt": """SELECT ranker, field, ranker || '|' || field AS run_key, num, et.n_rel, n_judged, coalesce(ap, 0) AS ap, coalesce(p10, 0) AS p10,
  coalesce(dcg / list_sum(list_transform(range(1, least(10, et.n_rel) + 1), lambda x: 1 / log2(x + 1))), 0) AS ndcg10, coalesce(rprec, 0) AS rprec, coalesce(recall100, 0) AS recall100, coalesce(judged10, 0) AS judged10, """
    + ", ".join(f"coalesce(i{i}, 0) AS i{i}" for i in range(11))
    + " FROM et CROSS JOIN keys LEFT JOIN got USING (ranker, field, num)",
    "rt": "SELECT row_number() OVER (ORDER BY cf DESC, term) AS rank, term, df, cf FROM ts",
}
def _needs(names: set[str], parts: dict[str, str]) -> set[str]:
    import re

    out, todo = set(), set(names)
    while todo:
        n = todo.pop()
        out.add(n)
        todo |= {m for m in parts if m not in out and re.search(rf"\b(?:FROM|JOIN)\s+{m}\b", parts[n])}
    return out


def _with(body: str, treatment: str = "nostem_stop", **more: str) -> str:
    """``body`` after the parts that it and ``more`` read, for a treatment of the texts."""
    import re

    parts = _parts(treatment)
    text = " ".join([body, *more.values()])
    first = {m for m in parts if re.search(rf"\b(?:FROM|JOIN)\s+{m}\b", text)}
    needed = _needs(first, parts)
    ctes = [f"{n} AS {'MATERIALIZED ' if n == 'stems' else ''}({parts[n]})" for n in parts if n in needed] + [f"{n} AS ({sql})" for n, sql in more.items()]
    return f"WITH {', '.join(ctes)} {body}"


_LETTERS = "".join(chr(c) for c in range(97, 123) if chr(c) != "y")


def _shape_sql(word: str) -> str:
    """c and v for a word's letters; a y is a vowel after a consonant. Each turn settles two of a run of y."""
    out = f"translate({word}, '{_LETTERS}', '{''.join('v' if c in 'aeiou' else 'c' for c in _LETTERS)}')"
    for _ in range(3):
        out = f"regexp_replace(regexp_replace({out}, 'cy', 'cv', 'g'), '(^|v)y', '\\1c', 'g')"
    return out


def _stem_parts() -> dict[str, str]:
    """The steps of the stemmer as tables, from ``vocab(term)`` to ``stems(term, stem)``."""
    m = "((len(sh) - len(replace(sh, 'vc', ''))) // 2)"
    short = "(len(st) > 2 AND right(sh, 3) = 'cvc' AND right(st, 1) NOT IN ('w', 'x', 'y'))"
    cut = lambda n: f"left(w, len(w) - {n})"
    ends = lambda e: f"ends_with(w, '{e}')"
    vowel = lambda x: f"contains({_shape_sql(x)}, 'v')"
    split = lambda source: f"SELECT term, w, suf, st, {_shape_sql('st')} AS sh FROM (SELECT term, w, suf, left(w, len(w) - len(suf)) AS st FROM {source})"
    pick = lambda source, when: f"SELECT term, w, CASE {when} ELSE '' END AS suf FROM {source}"
    swap = lambda table: " ".join(f"WHEN suf = '{a}' THEN st || '{b}'" for a, b in table)
    out = {
        "s0": "SELECT DISTINCT term, term AS w FROM vocab WHERE len(term) > 2",
        "s1": f"SELECT term, CASE WHEN {ends('sses')} OR {ends('ies')} THEN {cut(2)} WHEN {ends('s')} AND NOT {ends('ss')} THEN {cut(1)} ELSE w END AS w FROM s0",
        "s2": pick("s1", f"WHEN {ends('eed')} THEN 'eed' WHEN {ends('ed')} AND {vowel(cut(2))} THEN 'ed' WHEN {ends('ing')} AND {vowel(cut(3))} THEN 'ing'"),
        "s3": split("s2"),
        "s4": f"""SELECT term, CASE WHEN suf = '' THEN w WHEN suf = 'eed' THEN CASE WHEN {m} > 0 THEN {cut(1)} ELSE w END WHEN regexp_matches(st, '(at|bl|iz)$') THEN st || 'e'
          WHEN len(st) > 1 AND right(st, 1) = left(right(st, 2), 1) AND right(sh, 1) = 'c' THEN CASE WHEN right(st, 1) IN ('l', 's', 'z') THEN st ELSE left(st, len(st) - 1) END
          WHEN {m} = 1 AND {short} THEN st || 'e' ELSE st END AS w FROM s3""",
        "s5": f"SELECT term, CASE WHEN {ends('y')} AND {vowel(cut(1))} THEN {cut(1)} || 'i' ELSE w END AS w FROM s4",
    }
    source = "s5"
    for n, table in (("6", porter._TWO), ("7", porter._THREE)):
        out[f"s{n}a"] = pick(source, " ".join(f"WHEN {ends(a)} THEN '{a}'" for a, _ in table))
        out[f"s{n}b"] = split(f"s{n}a")
        out[f"s{n}"] = f"SELECT term, CASE WHEN suf = '' OR {m} = 0 THEN w {swap(table)} END AS w FROM s{n}b"
        source = f"s{n}"
    out["s8a"] = pick("s7", " ".join(f"WHEN {ends(a)}" + (f" AND right({cut(3)}, 1) IN ('s', 't')" if a == "ion" else "") + f" THEN '{a}'" for a in porter._FOUR))
    out["s8b"] = split("s8a")
    out["s8"] = f"SELECT term, CASE WHEN suf <> '' AND {m} > 1 THEN st ELSE w END AS w FROM s8b"
    out["s9a"] = pick("s8", f"WHEN {ends('e')} THEN 'e'")
    out["s9b"] = split("s9a")
    out["s9"] = f"SELECT term, CASE WHEN suf = 'e' AND ({m} > 1 OR {m} = 1 AND NOT {short}) THEN st ELSE w END AS w FROM s9b"
    out["s10"] = f"SELECT term, w, w AS st, {_shape_sql('w')} AS sh FROM s9"
    out["stems"] = f"SELECT term, CASE WHEN {ends('ll')} AND {m} > 1 THEN {cut(1)} ELSE w END AS stem FROM s10 UNION ALL SELECT DISTINCT term, term FROM vocab WHERE len(term) <= 2"
    return out


def _parts(treatment: str) -> dict[str, str]:
    """``PARTS`` for a treatment: which words are kept, and whether documents and queries hold words or stems."""
    stemmed, stop = TREATMENTS[treatment]
    parts = {}
    for n, sql in PARTS.items():
        if n == "kept":
            sql = "SELECT doc_idx, term, pos FROM tok" + (" WHERE term NOT IN (SELECT w FROM stops)" if stop else "")
            if stemmed:
                parts["qw0"] = f"SELECT num, field, unnest(l) AS term, generate_subscripts(l, 1) - 1 AS pos FROM (SELECT num, field, {_words('q')} AS l FROM (SELECT item_id AS num, * FROM (SELECT num AS item_id, field, q FROM fields)))"
                parts["vocab"] = "SELECT term FROM tok UNION SELECT term FROM qw0"
                parts |= _stem_parts()
                sql = f"SELECT doc_idx, stem AS term, pos FROM ({sql}) JOIN stems USING (term)"
        if n == "ql" and not stop:
            sql = f"SELECT num, field, {_words('q')} AS l FROM fields"
        if n == "qw" and stemmed:
            sql = f"SELECT num, field, stem AS term, pos FROM ({sql}) JOIN stems USING (term)"
        parts[n] = sql
    # Tables that a part reads come before it.
    order: list[str] = []

    def put(n: str) -> None:
        if n not in order:
            for m in sorted(_needs({n}, parts) - {n}):
                put(m)
            order.append(n)

    for n in parts:
        put(n)
    return {n: parts[n] for n in order}


def _r6(*columns: str) -> str:
    return ", ".join(f"round({c}, 6) AS {c}" for c in columns)


METRICS = ("ap", "p10", "ndcg10", "rprec", "recall100", "judged10")


def _hist(source: str, value: str, edges) -> str:
    e = _list(edges)
    return _with(
        "SELECT bin::INTEGER AS bin, left_edge, coalesce(n, 0) AS n FROM bins LEFT JOIN counted USING (bin)",
        bins=f"SELECT unnest(range({len(edges)})) AS bin, unnest({e}) AS left_edge",
        counted=f"SELECT greatest(len(list_filter({e}, lambda e: e <= {value})) - 1, 0) AS bin, count(*) AS n FROM {source} GROUP BY 1",
    )


def _explain(ranker: str) -> str:
    if ranker == "bm25":
        idf, part, join = "i", "c_bm25", ""
    else:
        s = ranker.removeprefix("tfidf_")
        idf, part, join = "c", f"c_{ranker} / nullif(norm_{s} * q_{s}, 0)", "LEFT JOIN norms n ON n.doc_idx = con.doc_idx LEFT JOIN qn ON qn.num = con.num AND qn.field = con.field"
    body = f"SELECT con.num, con.doc_idx, first_pos, term, qtf, tf, df, round({idf}, 6) AS idf, round({part}, 6) AS contribution FROM con JOIN top3 t ON t.num = con.num AND t.doc_idx = con.doc_idx {join} WHERE con.field = 'title' AND {part} IS NOT NULL"
    return _with(body, top3=f"SELECT num, doc_idx FROM run WHERE field = 'title' AND ranker = '{ranker}' AND rank <= 3")


def _checkpoints(total: str) -> str:
    return f"SELECT DISTINCT unnest(CASE WHEN {total} <= 1000 THEN [{total}] ELSE list_append(list_transform(range(40), lambda i: round(exp(ln(1000) + (ln({total}) - ln(1000)) * i / 39))::BIGINT), {total}) END) AS n_tokens FROM cs"


def oracle_sql() -> dict[str, str]:
    out = {
        "tokenize_counts": _with("SELECT docno, len(l)::INTEGER AS n_tokens FROM words JOIN docs USING (doc_idx)"),
        "raw_token_counts": _with("SELECT docno, len(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+'))::INTEGER AS n_tokens FROM docs"),
        "vocab_funnel": _with(
            """SELECT 'raw_alpha' AS step, count(*) AS n_types, sum(n)::BIGINT AS n_tokens FROM c UNION ALL SELECT 'minus_digits', count(*), sum(n)::BIGINT FROM c WHERE NOT regexp_matches(term, '[0-9]')
            UNION ALL SELECT 'minus_stopwords', count(*), sum(n)::BIGINT FROM c WHERE NOT regexp_matches(term, '[0-9]') AND term NOT IN (SELECT w FROM stops)""",
            c="SELECT term, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+')) AS term FROM docs) GROUP BY 1",
        ),
        "postings": _with("SELECT term, doc_idx, tf FROM po"),
        "term_stats": _with("SELECT term, df, cf FROM ts"),
        "doc_stats": _with("SELECT doc_idx, doc_len FROM ds"),
        "collection_stats": _with(f"SELECT n_docs, total_tokens, {_r6('avgdl')} FROM cs"),
        "stop_treatments": _with(
            """SELECT treatment, count(DISTINCT doc_idx) AS n_docs, count(term) AS total_tokens, count(DISTINCT term) AS n_types, round(count(term)::DOUBLE / count(DISTINCT doc_idx), 6) AS avgdl
            FROM (SELECT 'nostem_stop' AS treatment, d.doc_idx, term FROM docs d LEFT JOIN kept USING (doc_idx) UNION ALL SELECT 'nostem_nostop', d.doc_idx, term FROM docs d LEFT JOIN tok USING (doc_idx)) GROUP BY 1"""
        ),
        "idf_table": _with("SELECT term, df, round(c, 6) AS idf_cosine, round(i, 6) AS idf_bm25 FROM idf"),
        "doc_norms": _with(f"SELECT doc_idx, {_r6('norm_raw', 'norm_log')} FROM norms"),
        "gap_encode": _with(
            "SELECT term, block, string_agg(gap || ',' || tf, ',' ORDER BY doc_idx) AS gaps FROM g GROUP BY ALL",
            g="SELECT term, doc_idx // 65536 AS block, doc_idx, tf, doc_idx - coalesce(lag(doc_idx) OVER (PARTITION BY term, doc_idx // 65536 ORDER BY doc_idx), doc_idx // 65536 * 65536) AS gap FROM po",
        ),
        "gap_roundtrip": _with("SELECT term, doc_idx, tf FROM po"),
        "forward_index": _with("SELECT doc_idx, string_agg(term || ':' || tf, ' ' ORDER BY term) AS terms FROM po GROUP BY 1"),
        "query_terms": _with("SELECT num, field, term, qtf, first_pos::INTEGER AS first_pos, df FROM kt"),
        "query_unknown_terms": _with("SELECT num, field, term, qtf, first_pos::INTEGER AS first_pos FROM qt WHERE term NOT IN (SELECT term FROM ts)"),
        "search_single_query": _with(
            "SELECT rank::INTEGER AS rank, docno, round(score, 6) AS score FROM (SELECT *, row_number() OVER (ORDER BY round(score, 9) DESC, doc_idx) AS rank FROM s JOIN docs USING (doc_idx)) WHERE rank <= 10",
            q="SELECT unnest(['ingand', 'thand', 'erhe']) AS term",
            s=f"SELECT doc_idx, sum(i * (tf * {K1 + 1}::DOUBLE / (tf + {K1}::DOUBLE * ({1 - B}::DOUBLE + {B}::DOUBLE * doc_len / avgdl)))) AS score FROM q JOIN idf USING (term) JOIN po USING (term) JOIN ds USING (doc_idx) CROSS JOIN cs GROUP BY 1",
        ),
        "qrels": _with("SELECT num, docno, rel FROM qrels"),
        "eval_topics": _with("SELECT num, n_rel, n_judged FROM et"),
        "qrels_counts": _with(
            "SELECT count(*) FILTER (n_rel > 0) AS n_topics, count(*) AS n_topics_all, sum(n_rel)::BIGINT AS n_rel_total, count(*) FILTER (n_rel = 1) AS n_single_rel_topics, (SELECT count(DISTINCT docno) FROM qrels) AS n_judged_docs FROM b",
            b="SELECT num, sum(rel) AS n_rel FROM qrels GROUP BY 1",
        ),
        "metrics_per_topic": _with(f"SELECT num, n_rel, n_judged, {_r6(*METRICS)} FROM pt WHERE run_key = 'bm25|title'"),
        "metrics_per_topic_all_runs": _with(f"SELECT run_key, num, {_r6(*METRICS)} FROM pt"),
        "map_by_run": _with("SELECT run_key, count(*) AS n_topics, round(avg(ap), 6) AS map, " + ", ".join(f"round(avg({m}), 6) AS {m}" for m in METRICS[1:]) + " FROM pt GROUP BY 1"),
        "interp_curve": _with(" UNION ALL ".join(f"SELECT {i} AS level, round(avg(i{i}), 6) AS precision FROM pt WHERE run_key = 'bm25|title'" for i in range(11))),
        "paired_wins": _with(
            "SELECT round(avg(d), 6) AS mean_diff, count(*) FILTER (d >= 1e-9) AS wins, count(*) FILTER (d <= -1e-9) AS losses, count(*) FILTER (abs(d) < 1e-9) AS ties FROM d",
            d="SELECT a.ap - b.ap AS d FROM pt a JOIN pt b USING (num) WHERE a.run_key = 'bm25|title' AND b.run_key = 'tfidf_raw|title'",
        ),
        "best_run": _with(
            "SELECT num, title, n_rel, n_judged, run_key AS best_run, round(ap, 6) AS best_ap FROM b JOIN topics USING (num) WHERE place = 1",
            b="SELECT *, row_number() OVER (PARTITION BY num ORDER BY round(ap, 9) DESC, list_position(" + _list(f"{r}|{f}" for r in RANKERS for f in FIELDS) + ", run_key)) AS place FROM pt",
        ),
        "ap_by_run": _with("SELECT run_key, (row_number() OVER (PARTITION BY run_key ORDER BY num) - 1)::INTEGER AS place, round(ap, 6) AS ap FROM pt"),
        "zero_counts": _with("SELECT run_key, count(*) FILTER (ap = 0) AS n_zero, count(*) FILTER (ap < 0.1) AS n_below_01, count(*) FILTER (ap > 0.9) AS n_above_09, round(quantile_cont(ap, 0.5), 6) AS median_ap FROM pt GROUP BY 1"),
        "heaps_points": _with(
            "SELECT n_tokens, (SELECT count(*) FROM f WHERE f.spot <= c.n_tokens) AS n_types FROM c",
            p="SELECT term, row_number() OVER (ORDER BY doc_idx, pos) AS spot FROM kept", f="SELECT term, min(spot) AS spot FROM p GROUP BY 1", c=_checkpoints("total_tokens"),
        ),
        "ranked_terms": _with("SELECT rank, term, df, cf FROM rt"),
        "zipf_fit": _with("SELECT round(regr_slope(log10(cf), log10(rank)), 6) AS slope, round(regr_intercept(log10(cf), log10(rank)), 6) AS intercept FROM rt WHERE rank <= 1000"),
        "zipf_points": _with(
            "SELECT rank, term, cf FROM rt WHERE rank IN (SELECT r FROM z)",
            v="SELECT count(*) AS v FROM ts",
            z="SELECT unnest(CASE WHEN v <= 10 THEN range(1, v + 1) ELSE list_concat(range(1, 11), list_transform(range(50), lambda i: round(exp(ln(11) + (ln(v) - ln(11)) * i / 49))::BIGINT)) END) AS r FROM v",
        ),
        "top_terms": _with("SELECT term, cf, df FROM ts ORDER BY cf DESC, term LIMIT 25"),
        "longest_postings": _with("SELECT term, df, cf FROM ts ORDER BY df DESC, term LIMIT 20"),
        "posting_hist": _hist("ts", "df", POSTING_BINS),
        "doc_len_hist": _hist("ds", "doc_len", DOC_LEN_BINS),
        "posting_summary": _with("SELECT count(*) AS n_terms, sum(df)::BIGINT AS n_postings, round(avg(df), 6) AS mean_len, round(quantile_cont(df, 0.5), 6) AS median_len, max(df) AS max_len, round(avg((df = 1)::INT), 6) AS df1_share FROM ts"),
        "doc_len_summary": _with("SELECT round(avg(doc_len), 6) AS mean, round(quantile_cont(doc_len, 0.5), 6) AS median, round(quantile_cont(doc_len, 0.1), 6) AS p10, round(quantile_cont(doc_len, 0.9), 6) AS p90, max(doc_len) AS max FROM ds"),
        "corpus_summary": _with("SELECT count(*) AS n_docs, sum(len(l))::BIGINT AS total_tokens_alpha, count(*) FILTER (string_split(text, chr(10))[1] <> '') AS n_headlines FROM words JOIN docs USING (doc_idx)"),
        "sgml_parse": "SELECT * FROM (VALUES (0::BIGINT, 'X-9', DATE '2005-01-02', '', 'No headline.'), (1, 'X-10', DATE '1991-12-31', 'Café and more', 'One & two.' || ' ' || chr(10) || 'Three.')) t(doc_idx, docno, date, headline, text)",
        "topic_parse": "SELECT * FROM (VALUES (7, 'jet engine', 'Documents about jets.', 'Any jet.'), (3, 'bank money', 'About banks.', 'Any bank.')) t(num, title, \"desc\", narr)",
        "qrels_parse": "SELECT * FROM (VALUES (7, 'X-9', 1), (7, 'X-10', 1), (3, 'X-9', 1)) t(num, docno, rel)",
    }
    out["heaps_fit"] = _with(
        "SELECT round(CASE WHEN count(*) < 2 THEN 0 ELSE 10 ** regr_intercept(log10(n_types), log10(n_tokens)) END, 6) AS k, round(CASE WHEN count(*) < 2 THEN 0 ELSE regr_slope(log10(n_types), log10(n_tokens)) END, 6) AS beta FROM h",
        p="SELECT term, row_number() OVER (ORDER BY doc_idx, pos) AS spot FROM kept", f="SELECT term, min(spot) AS spot FROM p GROUP BY 1", c=_checkpoints("total_tokens"),
        h="SELECT n_tokens, (SELECT count(*) FROM f WHERE f.spot <= c.n_tokens) AS n_types FROM c",
    )
    for r in RANKERS:
        out[f"explain_{r}"] = _explain(r)
        for f in FIELDS:
            out[f"{r}_{f}_top10"] = _with(f"SELECT num, rank::INTEGER AS rank, docno, round(score, 6) AS score FROM run WHERE ranker = '{r}' AND field = '{f}' AND rank <= 10")
    cells = [(k1, b) for k1 in GRID_K1 for b in GRID_B]
    grid = _with(
        "SELECT k1, b, round(avg(coalesce(ap, 0)), 6) AS map FROM et CROSS JOIN cell LEFT JOIN a USING (num, k1, b) GROUP BY ALL",
        cell="SELECT * FROM (VALUES " + ", ".join(f"({k1}::DOUBLE, {b}::DOUBLE)" for k1, b in cells) + ") t(k1, b)",
        s="SELECT num, doc_idx, k1, b, sum(qtf * i * (tf * (k1 + 1) / (tf + k1 * (1 - b + b * doc_len / avgdl)))) AS score FROM con CROSS JOIN cell WHERE field = 'title' GROUP BY ALL",
        o=f"SELECT * FROM (SELECT s.*, docno, row_number() OVER (PARTITION BY num, k1, b ORDER BY round(score, 9) DESC, doc_idx) AS rank FROM s JOIN docs USING (doc_idx)) WHERE rank <= {TOP_N}",
        h="SELECT o.num, k1, b, rank, rel, n_rel, sum(coalesce(rel, 0)) OVER (PARTITION BY o.num, k1, b ORDER BY rank) AS h FROM o JOIN et USING (num) LEFT JOIN qrels USING (num, docno)",
        a="SELECT num, k1, b, sum(h / rank) FILTER (rel = 1) / max(n_rel) AS ap FROM h GROUP BY ALL",
    )
    out["bm25_grid"] = grid
    out["grid_swing"] = f"SELECT round(min(map), 6) AS worst, round(max(map), 6) AS best, round(max(map) - min(map), 6) AS swing FROM ({grid.replace('round(avg(coalesce(ap, 0)), 6)', 'avg(coalesce(ap, 0))')})"
    out["dead_topics"] = _with("SELECT num, count(*) AS n_runs FROM pt GROUP BY 1 HAVING max(ap) = 0")
    last = f"SELECT max(bin) AS last FROM ({out['doc_len_hist']}) WHERE n > 0"
    out["doc_len_hist_trimmed"] = f"SELECT bin, left_edge, n FROM ({out['doc_len_hist']}) CROSS JOIN ({last}) WHERE bin <= last"
    out["zipf_verdict"] = f"SELECT slope, intercept, CASE WHEN -slope < 0.95 THEN 'flat' WHEN -slope > 1.05 THEN 'steep' ELSE 'near 1' END AS verdict FROM ({out['zipf_fit']})"
    out["funnel_drops"] = f"""SELECT step, round(n_tokens / n0, 6) AS kept_tokens, round(n_types / t0, 6) AS kept_types, coalesce(n0 - n_tokens = max(n0 - n_tokens) OVER (), false) AS largest_drop
      FROM (SELECT *, lag(n_tokens) OVER w AS n0, lag(n_types) OVER w AS t0 FROM ({out['vocab_funnel']}) WINDOW w AS (ORDER BY list_position(['raw_alpha', 'minus_digits', 'minus_stopwords'], step)))"""
    out["bm25_grid_best"] = f"SELECT * FROM ({grid}) ORDER BY map DESC, k1, b LIMIT 1"
    out["stem_of_words"] = f"SELECT term, stem FROM ({_with('SELECT term, stem FROM stems', 'stem_stop')}) WHERE term IN (SELECT term FROM ({out['term_stats']}))"
    counts = "SELECT '{t}' AS treatment, n_docs, total_tokens, (SELECT count(*) FROM ts) AS n_types, round(avgdl, 6) AS avgdl FROM cs"
    out["stem_treatments"] = " UNION ALL ".join(f"SELECT * FROM ({_with(counts.format(t=t), t)})" for t in TREATMENTS)
    out["vocab_funnel_stemmed"] = f"{out['vocab_funnel']} UNION ALL SELECT 'stemmed' AS step, n_types, n_tokens FROM ({_with('SELECT (SELECT count(*) FROM ts) AS n_types, total_tokens AS n_tokens FROM cs', 'stem_stop')})"
    out["bm25_stemmed_top10"] = _with("SELECT num, rank::INTEGER AS rank, docno, round(score, 6) AS score FROM run WHERE ranker = 'bm25' AND field = 'title' AND rank <= 10", "stem_stop")
    out["stem_groups"] = _with(
        """SELECT stem, n_words, stem_cf, place::INTEGER AS place, term, cf FROM (SELECT *, row_number() OVER (PARTITION BY stem ORDER BY cf DESC, term) AS place FROM w JOIN b USING (stem)) WHERE place <= 8""",
        "stem_stop",
        w="SELECT term, stem, count(*) AS cf FROM tok JOIN stems USING (term) WHERE term NOT IN (SELECT w FROM stops) GROUP BY ALL",
        b="SELECT stem, count(*) AS n_words, sum(cf)::BIGINT AS stem_cf FROM w GROUP BY 1 ORDER BY n_words DESC, stem_cf DESC, stem LIMIT 12",
    )
    treated = {t: _with("SELECT num, ap, p10 FROM pt WHERE run_key = 'bm25|title'", t) for t in TREATMENTS}
    out["treatment_means"] = " UNION ALL ".join(f"SELECT '{t}' AS treatment, round(avg(ap), 6) AS map, round(avg(p10), 6) AS p10 FROM ({sql})" for t, sql in treated.items())
    pairs = ", ".join(f"('{k}', '{a}', '{b}', '{pair_label(a, b)}')" for k, a, b in PAIRS)
    out["paired_counts"] = f"""WITH every AS (SELECT run_key, num, ap FROM ({_with("SELECT run_key, num, ap FROM pt", "stem_stop")}) {" ".join(f"UNION ALL SELECT 'treat:{t}', num, ap FROM ({sql})" for t, sql in treated.items())}),
pair AS (SELECT * FROM (VALUES {pairs}) t(key, a, b, label)), d AS (SELECT key, label, x.ap - y.ap AS d FROM pair JOIN every x ON x.run_key = a JOIN every y ON y.run_key = b AND x.num = y.num)
SELECT key, label, round(avg(d), 6) AS mean_diff, count(*) FILTER (d >= 1e-9) AS wins, count(*) FILTER (d <= -1e-9) AS losses, count(*) FILTER (abs(d) < 1e-9) AS ties FROM d GROUP BY ALL"""
    out["sorted_differences"] = out["paired_counts"].split("SELECT key, label, round(avg(d)")[0].replace("SELECT key, label, x.ap", "SELECT key, x.ap") + "SELECT key, (row_number() OVER (PARTITION BY key ORDER BY d DESC) - 1)::INTEGER AS place, round(d, 6) AS diff FROM d"
    heaps = out["heaps_fit"].replace("SELECT round(CASE", "SELECT CASE", 1).replace("END, 6) AS k, round(CASE", "END AS k, CASE").replace("END, 6) AS beta", "END AS beta")
    out["heaps_residual"] = f"SELECT round(max(abs(log10(n_types) - log10(k * n_tokens ** beta))), 6) AS residual FROM ({out['heaps_points']}) CROSS JOIN ({heaps})"
    line = _with("SELECT regr_slope(log10(cf), log10(rank)) AS slope, regr_intercept(log10(cf), log10(rank)) AS intercept FROM rt WHERE rank <= 1000")
    out["zipf_fitted"] = f"SELECT rank, term, cf, round(10 ** (intercept + slope * log10(rank)), 6) AS fitted FROM ({out['zipf_points']}) CROSS JOIN ({line})"
    out["formatted_measures"] = _with(
        "SELECT format('{:,}', sum(n_judged)::BIGINT) AS n_judged, printf('%.3f', round(avg(ap), 6)) AS map, printf('%.1f', round(avg(p10), 6) * 100) || '%' AS p10, printf('%.3f', round(-avg(ap), 6)) AS loss FROM pt WHERE run_key = 'bm25|title'"
    )
    # The resamples are those of the generator that defines the intervals: one table of places for all groups of this size.
    places = np.random.default_rng(SEED).integers(0, len(SAMPLE[0][1]), size=(N_BOOT, len(SAMPLE[0][1])))
    drawn = "[" + ", ".join("[" + ", ".join(str(i + 1) for i in row) + "]" for row in places.tolist()) + "]"
    groups = ", ".join(f"('{k}', {_list(v)}::DOUBLE[])" for k, v in SAMPLE)
    out["bootstrap_sample"] = f"""WITH g AS (SELECT * FROM (VALUES {groups}) t(name, x)), r AS (SELECT unnest({drawn}) AS places),
m AS (SELECT name, x, list_avg(list_transform(places, lambda i: x[i])) AS m FROM g CROSS JOIN r)
SELECT name, round(list_avg(any_value(x)), 6) AS mean, round(quantile_cont(m, 0.025), 6) AS lo, round(quantile_cont(m, 0.975), 6) AS hi FROM m GROUP BY name"""
    return out
