"""What a build rests on: claims quoted from its reports, checksums and versions, a table of its files."""

from __future__ import annotations

import json
import platform
from pathlib import Path

import numpy as np
from pyspark.sql import SparkSession

from gleaner.operators import ranking
from gleaner.operators.statistics import N_BOOT, SEED
from gleaner.plans.export import claims, contract
from gleaner.sources import trec

#: The name of each claim and where its value stands (see ``_view``).
CLAIMS = """
n_docs: corpus n_docs
n_files: corpus n_files
date_min: corpus date_min
date_max: corpus date_max
total_tokens_alpha: corpus total_tokens_alpha
n_types_raw: funnel raw_alpha n_types
n_types_alpha: funnel minus_digits n_types
n_types_nostop: funnel minus_stopwords n_types
n_types_stem: funnel stemmed n_types
n_postings: index n_postings
median_doc_len: corpus doc_len_summary median
mean_doc_len: corpus doc_len_summary mean
max_posting_term: widest term
max_posting_df: widest df
n_terms_index: index n_terms
heaps_beta: heaps beta
zipf_slope: zipf slope
n_topics_all: judged n_topics_all
n_topics_eval: judged n_topics
n_rel_total: judged n_rel_total
n_judged_docs: judged n_judged_docs
n_single_rel_topics: judged n_single_rel_topics
map_tfidf_raw_title: run tfidf_raw|title map mean
map_tfidf_raw_title_lo: run tfidf_raw|title map lo
map_tfidf_raw_title_hi: run tfidf_raw|title map hi
map_tfidf_log_title: run tfidf_log|title map mean
map_bm25_title: run bm25|title map mean
map_bm25_title_lo: run bm25|title map lo
map_bm25_title_hi: run bm25|title map hi
p10_bm25_title: run bm25|title p10 mean
ndcg10_bm25_title: run bm25|title ndcg10 mean
judged10_bm25_title: run bm25|title judged10 mean
recall100_bm25_title: run bm25|title recall100 mean
diff_bm25_raw: pair bm25_vs_raw mean_diff
diff_bm25_raw_lo: pair bm25_vs_raw lo
diff_bm25_raw_hi: pair bm25_vs_raw hi
wins_bm25_raw: pair bm25_vs_raw wins
losses_bm25_raw: pair bm25_vs_raw losses
ties_bm25_raw: pair bm25_vs_raw ties
map_bm25_title_desc: run bm25|title_desc map mean
map_bm25_title_desc_narr: run bm25|title_desc_narr map mean
diff_desc_title: pair desc_vs_title mean_diff
diff_desc_title_lo: pair desc_vs_title lo
diff_desc_title_hi: pair desc_vs_title hi
diff_narr_title: pair narr_vs_title mean_diff
diff_narr_title_lo: pair narr_vs_title lo
diff_narr_title_hi: pair narr_vs_title hi
map_nostem_stop: treatment nostem_stop map mean
diff_stem_nostem: pair stem_vs_nostem mean_diff
diff_stem_nostem_lo: pair stem_vs_nostem lo
diff_stem_nostem_hi: pair stem_vs_nostem hi
map_stem_nostop: treatment stem_nostop map mean
diff_stop_nostop: pair stop_vs_nostop mean_diff
diff_stop_nostop_lo: pair stop_vs_nostop lo
diff_stop_nostop_hi: pair stop_vs_nostop hi
grid_best_map: best map
grid_best_k1: best k1
grid_best_b: best b
grid_default_map: default map
pr_p_at_r0_bm25: curve bm25|title 0
pr_p_at_r0_raw: curve tfidf_raw|title 0
"""


def read_json(out: Path, name: str) -> dict:
    """A report that ``write_reports`` wrote; another name or version than the file's is an error."""
    value = json.loads((Path(out) / f"{name}.json").read_text(encoding="utf-8"))
    if value.get("schema") != f"{name}.v1":
        raise ValueError(f"{name}.json has schema {value.get('schema')!r}")
    return value


def _by(rows: list[dict], *keys: str) -> dict:
    out: dict = {}
    for r in rows:
        at = out
        for k in keys[:-1]:
            at = at.setdefault(str(r[k]), {})
        at[str(r[keys[-1]])] = r
    return out


def _view(found: dict[str, dict]) -> dict:
    default = [c for c in found["bm25_grid"]["cells"] if (c["k1"], c["b"]) == (ranking.K1, ranking.B)]
    curves: dict = {}
    for r in found["pr_curves"]["curves"]:
        curves.setdefault(r["run_key"], {})[str(r["level"])] = r["precision"]
    return {
        "corpus": found["corpus"], "funnel": _by(found["vocab"]["funnel"], "step"), "heaps": found["vocab"]["heaps_fit"], "zipf": found["vocab"]["zipf_fit"],
        "index": found["postings"]["summary"], "widest": found["postings"]["longest"][0], "judged": found["runs"], "run": _by(found["runs"]["runs"], "run_key", "metric"),
        "pair": _by(found["comparisons"]["pairs"], "key"), "treatment": _by(found["treatments"]["rows"], "treatment", "metric"), "best": found["bm25_grid"]["best"],
        "default": default[0] if default else {}, "curve": curves,
    }


def percent_of(part: float, whole: float) -> float:
    return round(100.0 * part / whole, 1) if whole else 0.0


def all_claims(found: dict[str, dict], index_gz_bytes: int) -> dict:
    """Every claim from the reports and the size of the search index; a missing value is an error."""
    view, values = _view(found), {}
    for line in CLAIMS.strip().splitlines():
        name, path = line.split(": ")
        at = view
        for key in path.split(" "):
            at = at.get(key) if isinstance(at, dict) else None
        values[name] = at
    types = {s: view["funnel"].get(s, {}).get("n_types") or 0 for s in ("minus_stopwords", "stemmed")}
    words = {s: view["funnel"].get(s, {}).get("n_tokens") or 0 for s in ("minus_digits", "minus_stopwords")}
    values |= {
        "stem_reduction_pct": percent_of(types["minus_stopwords"] - types["stemmed"], types["minus_stopwords"]),
        "stopword_token_share_pct": percent_of(words["minus_digits"] - words["minus_stopwords"], words["minus_digits"]),
        "df1_share_pct": round(100.0 * view["index"]["df1_share"], 1), "index_gz_bytes": index_gz_bytes, "index_gz_mb": round(index_gz_bytes / 1e6, 2),
    }
    return claims(values)


def meta(spark: SparkSession, path: str, sums: str, n_docs: int, index_gz_bytes: int) -> dict:
    """What was built, from which files (all must agree with their checksums), with what."""
    trec.require_checksums(spark, path, sums)
    files = sorted((r["name"], r["actual"]) for r in trec.verify_checksums(spark, path, sums).collect())
    return contract(
        "meta", corpus_files=[{"name": n, "sha256": h} for n, h in files], n_docs=n_docs, index_gz_bytes=index_gz_bytes, index_gz_mb=round(index_gz_bytes / 1e6, 2),
        seed=SEED, n_boot=N_BOOT, python=platform.python_version(), numpy=np.__version__, spark=spark.version,
    )


def label(path: Path, base: Path) -> str:
    """A path below ``base`` relative to it, others whole; slashes lean forward."""
    path = Path(path)
    return (path.relative_to(base) if path.is_relative_to(base) else path).as_posix()


def file_table(sizes: dict[str, int]) -> str:
    """Names and bytes of the written files, and the total, for a console."""
    rows = [*sizes.items(), ("total", sum(sizes.values()))]
    left = max(len(n) for n, _ in rows)
    right = max(len(f"{b:,}") for _, b in rows)
    return "\n".join(f"{n:<{left}}  {b:>{right},}" for n, b in rows)
