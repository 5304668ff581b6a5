"""Markup, titles, keywords and other free text.

NFKD has no Spark built-in. The folding tables below are derived from ``unicodedata`` by rule
at import: code points that fold to one character go through ``translate`` (code-generated,
one pass); the few that expand go through a guarded map lookup.
"""

from __future__ import annotations

import sys
import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from .core import WS, blank_to_null, col, collapse, js_trim, let

# The words that never tell two titles apart.
STOP_WORDS = (
    "a an and are as at be by for from in into is of on or the to toward towards using via with"
).split()

# Greek letters that are spelled out; other Greek letters count as punctuation.
GREEK = {
    "α": "alpha", "β": "beta", "γ": "gamma", "δ": "delta", "ε": "epsilon", "λ": "lambda",
    "μ": "mu", "π": "pi", "σ": "sigma", "τ": "tau", "φ": "phi", "ω": "omega",
}

KEYWORD_LIMIT = 120
_DASHES = "‐‑‒–—―−"


def _significant(ch: str) -> bool:
    low = ch.lower()
    return ("a" <= low <= "z" and len(low) == 1) or "0" <= ch <= "9" or ch in _DASHES or ch == "-" or low in GREEK or ch.isspace()


@lru_cache(maxsize=1)
def fold_tables() -> tuple[str, str, dict[str, str]]:
    """(from, to) for one-to-one folds, and the expanding folds."""
    one_from, one_to, many = [], [], {}
    for cp in range(0xA0, sys.maxunicode + 1):
        if 0xD800 <= cp <= 0xDFFF or 0xAC00 <= cp <= 0xD7A3 or 0x300 <= cp <= 0x36F:
            continue
        ch = chr(cp)
        full = unicodedata.normalize("NFKD", ch)
        if full == ch:
            continue
        bare = "".join(x for x in full if not 0x300 <= ord(x) <= 0x36F)
        if not any(_significant(x) for x in bare):
            continue
        if len(bare) == 1:
            one_from.append(ch)
            one_to.append(bare)
        else:
            many[ch] = "".join(x if _significant(x) else " " for x in bare)
    dashes = [d for d in _DASHES if d not in one_from]
    one_from += dashes
    one_to += ["-"] * len(dashes)
    one_to = ["-" if x in _DASHES else x for x in one_to]
    drop = [chr(x) for x in range(0x300, 0x370)]  # translate deletes what has no counterpart
    return "".join(one_from + drop), "".join(one_to), many


def fold_accents(c: Column) -> Column:
    """NFKD without U+0300-036F, exact for everything the title alphabet keeps."""
    src, dst, many = fold_tables()
    table = F.str_to_map(F.lit("\x01".join(f"{k}\x02{v}" for k, v in many.items())), F.lit("\x01"), F.lit("\x02"))
    klass = "[" + "".join(many) + "]"
    expanded = let(
        c,
        lambda v: F.when(
            F.regexp_like(v, F.lit(klass)),
            F.array_join(F.transform(F.split(v, ""), lambda ch: F.coalesce(F.try_element_at(table, ch), ch)), ""),
        ).otherwise(v),
    )
    return F.translate(expanded, src, dst)


def _decode_numeric(c: Column) -> Column:
    """&#NNN; and &#xHHH; for code points 1 .. 0x10FFFE; surrogates and larger values stay as written."""

    def one(acc: Column, ent: Column) -> Column:
        hexa = F.lower(F.substring(ent, 3, 1)) == "x"
        digits = F.when(hexa, F.regexp_extract(ent, "(?i)^&#x0*([0-9a-f]+);", 1)).otherwise(
            F.hex(F.expr("try_cast(null as bigint)").cast("bigint"))
        )
        dec = F.regexp_extract(ent, "^&#0*([0-9]+);", 1)
        digits = F.when(hexa, digits).otherwise(F.when(F.length(dec) <= 8, F.hex(dec.try_cast("bigint"))))
        point = F.conv(digits, 16, 10).try_cast("bigint")
        ok = (F.length(digits) <= 6) & (point > 0) & (point < 0x10FFFF) & ~point.between(0xD800, 0xDFFF)
        return F.when(ok, F.replace(acc, ent, F.decode(F.unhex(F.lpad(digits, 8, "0")), "UTF-32"))).otherwise(acc)

    return let(
        c,
        lambda v: F.when(
            F.contains(v, F.lit("&#")),
            F.aggregate(F.array_distinct(F.regexp_extract_all(v, F.lit("(?i)&#(?:x[0-9a-f]+|[0-9]+);"), F.lit(0))), v, one),
        ).otherwise(v),
    )


def _decode_once(c: Column) -> Column:
    for name, value in (("nbsp", " "), ("amp", "&"), ("lt", "<"), ("gt", ">"), ("quot", '"'), ("apos", "'")):
        c = F.regexp_replace(c, f"(?i)&{name};", value)
    return _decode_numeric(c)


def _drop_tags(v: Column) -> Column:
    return F.when(F.contains(v, F.lit("<")), F.regexp_replace(v, "<[^>]*>", " ")).otherwise(v)


def strip_markup(c: Column | str) -> Column:
    """Tags become blanks, entities are decoded up to three times, tags so revealed go too, white space collapses.

    Each step is guarded by a plain search, because most values hold neither tags nor entities."""

    def decode(v: Column) -> Column:
        return F.when(F.contains(v, F.lit("&")), let(_decode_once(_decode_once(_decode_once(v))), _drop_tags)).otherwise(v)

    return collapse(let(let(col(c), _drop_tags), decode))


def clean_text(c: Column | str) -> Column:
    """Markup-free text, NULL when nothing is left."""
    return blank_to_null(strip_markup(c))


def without_stop_words(normalized: Column) -> Column:
    """Drops stop words, but never down to nothing."""
    stop = F.array(*[F.lit(w) for w in STOP_WORDS])

    def body(v: Column) -> Column:
        return let(
            F.array_join(F.filter(F.split(v, " "), lambda t: (t != "") & ~F.array_contains(stop, t)), " "),
            lambda kept: F.when(kept != "", kept).otherwise(v),
        )

    return let(normalized, body)


def is_ascii(v: Column) -> Column:
    return F.octet_length(v) == F.length(v)


def normalize_stripped(stripped: Column, keep_hyphens: bool = True) -> Column:
    """Folding only runs where there is something to fold."""

    def spelled(v: Column) -> Column:
        v = F.lower(fold_accents(v))
        for greek, latin in GREEK.items():
            v = F.replace(v, F.lit(greek), F.lit(latin))
        return v

    def joined(v: Column) -> Column:
        return F.when(F.contains(v, F.lit("-")), F.regexp_replace(v, "(^| )-+|-+($| )", "$1$2")).otherwise(v)

    v = let(stripped, lambda x: F.when(is_ascii(x), F.lower(x)).otherwise(spelled(x)))
    v = F.regexp_replace(v, "[^a-z0-9-]+" if keep_hyphens else "[^a-z0-9]+", " ")
    if keep_hyphens:
        v = let(v, joined)
    return F.trim(let(v, lambda x: F.when(F.contains(x, F.lit("  ")), F.regexp_replace(x, " +", " ")).otherwise(x)))


def normalize_title(c: Column | str, remove_stop_words: bool = False, keep_hyphens: bool = True) -> Column:
    """Lower-case ASCII letters, digits, blanks and joining hyphens. NULL gives ''."""
    v = normalize_stripped(strip_markup(F.coalesce(col(c), F.lit(""))), keep_hyphens)
    return without_stop_words(v) if remove_stop_words else v


def title_tokens(c: Column | str) -> Column:
    return F.filter(F.split(normalize_title(c, remove_stop_words=True), " "), lambda t: t != "")


def title_fingerprint(c: Column | str) -> Column:
    return F.replace(normalize_title(c, remove_stop_words=True, keep_hyphens=False), F.lit(" "), F.lit(""))


def _keyword_from_stripped(stripped: Column) -> Column:
    cut = let(
        normalize_stripped(stripped),
        lambda v: F.when(F.length(v) > KEYWORD_LIMIT, F.trim(F.substring(v, 1, KEYWORD_LIMIT))).otherwise(
            F.when(~v.isin(STOP_WORDS), v)
        ),
    )
    return let(cut, blank_to_null)


def normalize_keyword(c: Column | str) -> Column:
    """NULL for blanks and for a lone stop word; at most 120 characters."""
    return _keyword_from_stripped(strip_markup(F.coalesce(col(c), F.lit(""))))


def normalize_keywords(arr: Column | str) -> Column:
    """Splits on ; , | after markup removal, normalizes, keeps the first of equal values. NULL gives []."""
    parts = F.flatten(
        F.transform(F.coalesce(F.array_compact(col(arr)), F.array().cast("array<string>")), lambda x: F.split(strip_markup(x), "[;,|]"))
    )
    return F.array_distinct(F.array_compact(F.transform(parts, normalize_keyword)))


def keyword_tokens(arr: Column | str) -> Column:
    """Set of content words of an already normalized keyword list."""
    stop = F.array(*[F.lit(w) for w in STOP_WORDS])
    words = F.flatten(F.transform(F.coalesce(F.array_compact(col(arr)), F.array().cast("array<string>")), lambda k: F.split(k, f"{WS}+")))
    return F.array_distinct(F.filter(words, lambda t: (t != "") & ~F.array_contains(stop, t)))


def term_list(c: Column | str) -> Column:
    """Bag of words for cosine: normalized tokens of three or more letters, no stop words."""
    stop = F.array(*[F.lit(w) for w in STOP_WORDS])
    return F.filter(F.split(normalize_title(c), " "), lambda t: (F.length(t) >= 3) & ~F.array_contains(stop, t))


def year_hint(c: Column | str, as_of_year: int) -> Column:
    """A year in brackets, else the first free-standing one; 1900 .. as_of_year + 1."""
    text = F.coalesce(col(c), F.lit(""))
    found = F.coalesce(
        blank_to_null(F.regexp_extract(text, r"\(((?:19|20)\d{2})\)", 1)),
        blank_to_null(F.regexp_extract(text, r"\b((?:19|20)\d{2})\b", 1)),
    ).try_cast("int")
    return let(found, lambda y: F.when(y.between(1900, as_of_year + 1), y))


def clean_year(c: Column | str, as_of_year: int) -> Column:
    """Integer years, or the first plausible year in a string; 1500 .. as_of_year + 2."""
    text = col(c).cast("string")
    direct = F.when(F.regexp_like(text, F.lit(r"^-?\d+$")), text.try_cast("int")).otherwise(
        F.regexp_extract(text, r"(?:1[5-9]\d{2}|20\d{2}|21\d{2})", 0).try_cast("int")
    )
    return let(direct, lambda y: F.when(y.between(1500, as_of_year + 2), y))


def sanitize_text(c: Column | str) -> Column:
    """Control, zero-width and BOM characters become blanks; white space collapses."""
    return collapse(F.regexp_replace(col(c), "[\\u0000-\\u0008\\u000b\\u000c\\u000e-\\u001f\\u007f-\\u009f\\u200b-\\u200f\\u2028\\u2029\\ufeff]", " "))


def looks_distinctive(normalized: Column) -> Column:
    """At least 15 characters and three words."""
    words = F.size(F.filter(F.split(normalized, " "), lambda t: t != ""))
    return F.coalesce((F.length(normalized) >= 15) & (words >= 3), F.lit(False))


def cache_key(*parts: Column) -> Column:
    """Lower-cased, blank-collapsed parts joined by |; empty parts are left out."""
    cleaned = [let(collapse(F.lower(p.cast("string"))), blank_to_null) for p in parts]
    return F.concat_ws("|", *cleaned)


def trim_or_null(c: Column | str) -> Column:
    return let(js_trim(col(c)), blank_to_null)
