"""Text columns: keywords, chunks, fingerprints, dirty numbers and periods."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from lagloom.functions import fixed


def any_keyword(text: Column, keywords: list[str], ignore_case: bool = False) -> Column:
    """Whether one of the keywords occurs (plain substrings)."""
    if ignore_case:
        text, keywords = F.lower(text), [k.lower() for k in keywords]
    return reduce(lambda a, b: a | b, [text.contains(k) for k in keywords], F.lit(False))


def matched_keywords(text: Column, keywords: list[str]) -> Column:
    """The keywords that occur, without regard to case, in the order of the list."""
    return F.filter(F.array(*map(F.lit, keywords)), lambda k: F.contains(F.lower(text), F.lower(k)))


def chunks(text: Column, size: int = fixed.CHUNK_CHARS, step: int = fixed.CHUNK_STEP, least: int = fixed.CHUNK_MIN) -> Column:
    """Overlapping slices, trimmed; those of at most ``least`` characters go before numbering."""
    n = F.length(text)
    starts = F.when(n > 0, F.sequence(F.lit(0), n - 1, F.lit(step))).otherwise(F.array().cast("array<int>"))
    sliced = F.transform(starts, lambda s: F.regexp_replace(F.substring(text, s + 1, F.lit(size)), r"^\s+|\s+$", ""))
    return F.filter(sliced, lambda c: F.length(c) > least)


def hypothesis_fingerprint(text: Column, chars: int = 55) -> Column:
    """The first characters in lower case, with every number as N."""
    return F.regexp_replace(F.trim(F.lower(F.substring(text, 1, chars))), r"\d+", "N")


def local_number(text: Column) -> Column:
    """'1.234,5%' -> 1234.5; null where that is no number. Dots are thousands here, always."""
    plain = F.translate(F.regexp_replace(text, "[ \\s.%]", ""), ",", ".")
    return plain.try_cast("double")


def percent_number(text: Column) -> Column:
    """'0,25%' and '0.25%' -> 0.25; null where that is no number."""
    return F.translate(F.regexp_replace(text, "[ \\s%]", ""), ",", ".").try_cast("double")


def volume_number(text: Column) -> Column:
    """'1,5K', '2M', '3B' -> a number."""
    unit = F.upper(F.substring(F.trim(text), -1, 1))
    factor = F.when(unit == "K", 1e3).when(unit == "M", 1e6).when(unit == "B", 1e9).otherwise(1.0)
    return F.translate(F.regexp_replace(text, r"[KMBkmb\s ]", ""), ",", ".").try_cast("double") * factor


def month_period(period: Column) -> Column:
    """'M.YYYY' -> first day of the month; null for anything else."""
    ok = period.like("%.____")
    month = F.split_part(period, F.lit("."), F.lit(1)).try_cast("int")
    year = F.split_part(period, F.lit("."), F.lit(2)).try_cast("int")
    return F.when(ok & month.between(1, 12) & (year > 1990), F.try_make_date(year, month, F.lit(1)) if hasattr(F, "try_make_date") else F.make_date(year, month, F.lit(1)))


def error_class(message: Column, classes: dict[str, list[str]] | None = None) -> Column:
    """The first class with a substring in the message, without regard to case; otherwise 'unknown'."""
    out = None
    for name, parts in (classes or fixed.ERROR_CLASSES).items():
        if parts:
            hit = any_keyword(message, parts, ignore_case=True)
            out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise("unknown")


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cos(a, b), in double; null for a zero vector."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return 1 - F.try_divide(dot, norm(a) * norm(b))
