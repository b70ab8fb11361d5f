"""The Porter stemmer (1980, with its author's later departures), by rules over suffix tables."""

from __future__ import annotations

from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values of the algorithm: suffix and replacement by step. Of a step, the first suffix that fits
# decides. Steps 2 and 3 need a stem of measure 1, step 4 one of measure 2.
STEP_2 = (
    "ational ate, tional tion, enci ence, anci ance, izer ize, bli ble, alli al, entli ent, eli e, ousli ous, ization ize, "
    "ation ate, ator ate, alism al, iveness ive, fulness ful, ousness ous, aliti al, iviti ive, biliti ble, logi log"
)
STEP_3 = "icate ic, ative -, alize al, iciti ic, ical ic, ful -, ness -"
STEP_4 = "al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize"


def _table(text: str) -> list[tuple[str, str]]:
    pairs = [p.split() for p in text.split(",")]
    return sorted(((a, b.strip("-")) for a, b in pairs), key=lambda p: -len(p[0]))


_TWO, _THREE, _FOUR = _table(STEP_2), _table(STEP_3), sorted(STEP_4.split(), key=len, reverse=True)


_LETTERS = str.maketrans({c: "v" if c in "aeiou" else "c" for c in "abcdefghijklmnopqrstuvwxz"})


def _shape(stem: str) -> str:
    """c for consonants, v for vowels; y is a vowel after a consonant."""
    out = stem.translate(_LETTERS)
    while (at := out.find("y")) >= 0:
        out = f"{out[:at]}{'v' if at and out[at - 1] == 'c' else 'c'}{out[at + 1 :]}"
    return out


def measure(stem: str) -> int:
    """How often vowels are followed by consonants."""
    return _shape(stem).count("vc")


def _has_vowel(stem: str) -> bool:
    return "v" in _shape(stem)


def _twin(word: str) -> bool:
    return len(word) > 1 and word[-1] == word[-2] and _shape(word)[-1] == "c"


def _short(word: str) -> bool:
    """Ends consonant, vowel, consonant, the last not w, x or y."""
    return len(word) > 2 and _shape(word)[-3:] == "cvc" and word[-1] not in "wxy"


def _swap(word: str, table: list[tuple[str, str]]) -> str:
    for end, new in table:
        if word.endswith(end):
            stem = word[: -len(end)]
            return stem + new if measure(stem) > 0 else word
    return word


def _plural_and_past(w: str) -> str:
    if w.endswith(("sses", "ies")):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    if w.endswith("eed"):
        return w[:-1] if measure(w[:-3]) > 0 else w
    end = next((e for e in ("ed", "ing") if w.endswith(e) and _has_vowel(w[: -len(e)])), None)
    if end is None:
        return w
    w = w[: -len(end)]
    if w.endswith(("at", "bl", "iz")):
        return w + "e"
    if _twin(w):
        return w if w[-1] in "lsz" else w[:-1]
    return w + "e" if measure(w) == 1 and _short(w) else w


def _drop(w: str) -> str:
    for end in _FOUR:
        if w.endswith(end):
            stem = w[: -len(end)]
            if end == "ion" and not stem.endswith(("s", "t")):
                continue
            return stem if measure(stem) > 1 else w
    return w


def _tidy(w: str) -> str:
    m = measure(w[:-1]) if w.endswith("e") else 0
    if w.endswith("e") and (m > 1 or m == 1 and not _short(w[:-1])):
        w = w[:-1]
    return w[:-1] if w.endswith("ll") and measure(w) > 1 else w


@lru_cache(1 << 17)
def stem(word: str) -> str:
    """The stem of a lower-case word; words of one or two letters stay."""
    if len(word) <= 2:
        return word
    w = _plural_and_past(word)
    if w.endswith("y") and _has_vowel(w[:-1]):
        w = w[:-1] + "i"
    return _tidy(_drop(_swap(_swap(w, _TWO), _THREE)))


def stem_map(words: DataFrame) -> DataFrame:
    """``term, stem`` for the distinct words of ``words(term)``: each word is stemmed once, on all cores
    (a number of partitions is named, as adaptive planning would see few bytes and join them)."""

    @F.pandas_udf(T.StringType())
    def stems(s: pd.Series) -> pd.Series:
        return s.map(stem)

    n = int(words.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return words.select("term").distinct().repartition(n, "term").select("term", stems("term").alias("stem"))


def register(spark) -> None:
    """Make ``porter_stem(word)`` callable from SQL."""
    spark.udf.register("porter_stem", F.pandas_udf(lambda s: s.map(stem), T.StringType()))
