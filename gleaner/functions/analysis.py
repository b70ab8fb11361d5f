"""Text analysis as column expressions: tokens, stopwords, query fields, headlines, dates."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Default stopwords, used where no list is given; ``sources.trec.stopwords`` reads a list from a file.
STOPWORDS = tuple(
    "a about after all also an and any are as at be because been before being between both but by can could did do does for from had "
    "has have he her here him his how i if in into is it its just may me more most much must my no not now of off on one only or other "
    "our out over own same she should so some such than that the their them then there these they this those through to too under until "
    "up upon us very was we were what when where which while who whom why will with would you your".split()
)


def _text(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def raw_tokens(text: Column) -> Column:
    """Runs of a-z and 0-9 of the lower-cased text, in order."""
    return F.regexp_extract_all(F.lower(_text(text)), F.lit("([a-z0-9]+)"), 1)


def tokens(text: Column) -> Column:
    """``raw_tokens`` without those that hold a digit: runs of letters with neither letter nor digit beside them."""
    return F.regexp_extract_all(F.lower(_text(text)), F.lit("(?<![a-z0-9])([a-z]++)(?![0-9])"), 1)


def without(words: Column, stopwords: Iterable[str] | None) -> Column:
    """Drop stopwords and keep order and repeats; no list, or an empty one, drops nothing."""
    stops = list(stopwords or ())
    return F.filter(words, lambda t: ~t.isin(stops)) if stops else words


def unnested(df: DataFrame, elements: Column, name: str, *columns: Column | str) -> DataFrame:
    """``columns`` and a row per element that isn't null. In the outer form, as Catalyst would first test the
    array for emptiness and push that below exchanges and joins, so that each text would be split twice."""
    return df.select(*columns, F.explode_outer(elements).alias(name)).where(F.col(name).isNotNull())


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def collapse(text: Column) -> Column:
    """White space as single spaces, none at the ends."""
    return strip(F.regexp_replace(text, r"(?U)\s+", " "))


#: Query field -> the topic columns it joins, in this order.
FIELDS = {"title": ("title",), "title_desc": ("title", "desc"), "title_desc_narr": ("title", "desc", "narr")}


def query_text(field: str) -> Column:
    if field not in FIELDS:
        raise ValueError(f"unknown query field {field!r}; known: {', '.join(FIELDS)}")
    return F.concat_ws(" ", *[F.col(c) for c in FIELDS[field]])


def iso_date(yymmdd: Column) -> Column:
    """A date from YYMMDD; years from 90 on belong to the 1900s."""
    s = strip(yymmdd)
    century = F.when(F.substring(s, 1, 2).cast("int") >= 90, "19").otherwise("20")
    return F.to_date(F.concat(century, s), "yyyyMMdd")


def clean_headline(headline: Column) -> Column:
    """Without the paper's date stamp, on one line, 200 characters at most."""
    bare = F.regexp_replace(headline, r"(?U)^\s*FT\s+\d{1,2}\s+[A-Z]{3}\s+\d{2}\s*/\s*", "")
    return F.substring(collapse(bare), 1, 200)


def percentage(part: Column, whole: Column) -> Column:
    return F.when(whole == 0, 0.0).otherwise(F.round(part * 100.0 / whole, 1))


def histogram_bin(value: Column, edges: Iterable[int]) -> Column:
    """Index of the closed-open bin; the last is open, values below the first belong to it."""
    bins = F.array(*[F.lit(e) for e in edges])
    return F.greatest(F.size(F.filter(bins, lambda e: e <= value)) - 1, F.lit(0))
