"""SQL access: the tables of an index as temporary views, and the stemmer as a function."""

from __future__ import annotations

from gleaner.functions import porter
from gleaner.operators.index import Index


def register(index: Index, prefix: str = "") -> list[str]:
    """Views docs, postings, doc_stats, term_stats and collection_stats; ``porter_stem(word)`` in SQL."""
    spark = index.postings.sparkSession
    tables = {"docs": index.docs, "postings": index.postings, "doc_stats": index.doc_stats, "term_stats": index.term_stats, "collection_stats": index.collection}
    for name, df in tables.items():
        df.createOrReplaceTempView(prefix + name)
    porter.register(spark)
    return [prefix + n for n in tables]
