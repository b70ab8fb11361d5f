"""Numbers and dates as readers see them, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def whole(n: Column) -> Column:
    """319795 as 319,795."""
    return F.format_number(F.round(n).cast("long"), 0)


def fixed(v: Column, digits: int = 2) -> Column:
    """So many decimals; what rounds to zero has no sign."""
    text = F.format_string(f"%.{digits}f", v.cast("double"))
    return F.when(text.rlike(r"^-[0.]+$"), F.substring(text, F.lit(2), F.length(text))).otherwise(text)


def score(v: Column) -> Column:
    return fixed(v, 3)


def signed(v: Column, digits: int = 3) -> Column:
    """A difference: gains carry a plus."""
    return F.concat(F.when(v > 0, "+").otherwise(""), fixed(v, digits))


def points(v: Column, digits: int = 1) -> Column:
    """Percentage points: 43.7 as 43.7%."""
    return F.concat(fixed(v, digits), F.lit("%"))


def percent(share: Column, digits: int = 1) -> Column:
    """A share: 0.2431 as 24.3%."""
    return points(share * 100, digits)


def times(ratio: Column) -> Column:
    """2.015 as 2.0x; from ten on without decimals."""
    return F.concat(F.when(ratio >= 10, fixed(ratio, 0)).otherwise(fixed(ratio, 1)), F.lit("x"))


def interval(lo: Column, hi: Column, digits: int = 3) -> Column:
    return F.concat(F.lit("95% CI "), fixed(lo, digits), F.lit(" to "), fixed(hi, digits))


def long_date(iso: Column) -> Column:
    """1991-05-14 as 14 May 1991; what isn't a date stays."""
    text = iso.cast("string")
    day = F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_timestamp(text, F.lit("yyyy-MM-dd")))
    return F.coalesce(F.date_format(day, "d MMMM yyyy"), text)


def megabytes(size: Column) -> Column:
    return F.round(size / 1e6, 2)
