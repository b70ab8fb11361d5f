"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.llm import ann, embed_dedup, html_text, minhash, mixing, packing, pii, quality, suffix_dedup, urls
from gleaner.llm.common import table


def op1_hilbert_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


#: The contract of op2: three words, a similarity of 0.85.
OP2 = minhash.MinHashParams(words=3, num=85, den=100)


def op2_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), OP2)


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.filter_urls(table(spark, sf_dir, "pages"))


def op4_html_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op5_quality_net(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mix(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "source", "mix_weight", "mix_epoch", "mix_block", "mix_pos")


def op7_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op8_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymise(table(spark, sf_dir, "documents"))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_hilbert_search, op2_minhash_dedup, op3_url_filter, op4_html_density, op5_quality_net, op6_source_mixing, op7_embedding_dedup, op8_pii_surrogates, op9_suffix_dedup, op10_packing)}


def oracle_sql() -> dict[str, str]:
    return {
        "op1_hilbert_search": ann.oracle(),
        "op2_minhash_dedup": minhash.oracle(OP2.words, OP2.num, OP2.den),
        "op3_url_filter": urls.oracle(),
        "op7_embedding_dedup": embed_dedup.oracle(),
        "op9_suffix_dedup": suffix_dedup.oracle(),
    }
