"""Small building blocks shared by all column functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# ECMAScript white space; Java's \s is ASCII only, so the class is spelled out everywhere.
WS = "[\\u0009-\\u000d\\u0020\\u00a0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000\\ufeff]"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluates ``value`` once and binds it in ``body``, so that an expression used twice isn't computed twice."""
    return F.element_at(F.transform(F.array(value), body), 1)


_WS_CHARS = "\t\n\x0b\x0c\r \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"


def js_trim(c: Column) -> Column:
    return F.btrim(c, F.lit(_WS_CHARS))


def collapse(c: Column) -> Column:
    """Every run of white space becomes one blank. A cheap search finds the values that hold more than single blanks
    between ASCII characters; only those go through the replacement by the full class."""
    other = "[\\u0009-\\u000d\\u00a0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000\\ufeff]"
    plain = ~F.regexp_like(c, F.lit("[\\u0009-\\u000d\\u0080-\\uffff]|  "))
    return F.trim(F.when(plain, c).otherwise(F.regexp_replace(c, f"{other}{WS}*| {WS}+", " ")))


def blank_to_null(c: Column) -> Column:
    return F.when(c != "", c)


def clamp01(c: Column) -> Column:
    """NaN, infinities and NULL count as 0."""
    safe = F.coalesce(c.cast("double"), F.lit(0.0))
    finite = ~(F.isnan(safe) | (F.abs(safe) == F.lit(float("inf"))))
    return F.when(finite, F.greatest(F.lit(0.0), F.least(F.lit(1.0), safe))).otherwise(F.lit(0.0))


def round_score(c: Column) -> Column:
    """Half-up to four decimals on the binary double."""
    return F.floor(clamp01(c) * F.lit(10000.0) + F.lit(0.5)).cast("double") / F.lit(10000.0)


def ordered_distinct(arr: Column, key: Callable[[Column], Column] = F.lower) -> Column:
    """First-wins distinct under ``key``. NULL array gives NULL, NULL elements are dropped.

    The positions of first occurrences are found on the key array, so the cost is one
    hash-based ``array_distinct`` plus lookups instead of a quadratic fold over the values."""
    clean = F.array_compact(arr)
    return let(
        F.struct(clean.alias("v"), F.transform(clean, key).alias("k")),
        lambda s: F.transform(F.array_distinct(s["k"]), lambda k: F.element_at(s["v"], F.array_position(s["k"], k).cast("int"))),
    )


def capped(arr: Column, n: int) -> Column:
    return F.slice(arr, 1, n)
