"""DuckDB expressions that say the same as the column functions; used to check queries side by side."""

from __future__ import annotations

from .functions.identifiers import DOI_BODY
from .functions.text import GREEK, STOP_WORDS, fold_tables

_WS = r"[\x09-\x0d\x20\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]"
STOP = "[" + ", ".join(f"'{w}'" for w in STOP_WORDS) + "]"


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def rx(x: str, pattern: str, by: str) -> str:
    return f"regexp_replace({x}, {q(pattern)}, {q(by)}, 'g')"


def collapse(x: str) -> str:
    return f"trim({rx(x, _WS + '+', ' ')})"


def strip_markup(x: str) -> str:
    v = rx(x, "<[^>]*>", " ")
    for _ in range(3):
        for name, value in (("nbsp", " "), ("amp", "&"), ("lt", "<"), ("gt", ">"), ("quot", '"'), ("apos", "'")):
            v = rx(v, f"(?i)&{name};", value)
    return collapse(rx(v, "<[^>]*>", " "))


def fold(x: str) -> str:
    src, dst, many = fold_tables()
    table = "MAP {" + ", ".join(f"{q(k)}: {q(v)}" for k, v in many.items()) + "}"
    spread = f"array_to_string(list_transform(string_split({x}, ''), lambda ch: coalesce({table}[ch], ch)), '')"
    src, marks = src[: len(dst)], src[len(dst) :]
    return f"translate({rx(spread, f'[{marks[0]}-{marks[-1]}]', '')}, {q(src)}, {q(dst)})"


def normalize_stripped(x: str, hyphens: bool = True) -> str:
    v = f"lower({fold(x)})"
    for a, b in GREEK.items():
        v = f"replace({v}, {q(a)}, {q(b)})"
    v = rx(v, "[^a-z0-9-]+" if hyphens else "[^a-z0-9]+", " ")
    if hyphens:
        v = rx(v, "(^| )-+|-+($| )", r"\1\2")
    return f"trim({rx(v, ' +', ' ')})"


def normalize_title(x: str, hyphens: bool = True) -> str:
    return normalize_stripped(strip_markup(f"coalesce({x}, '')"), hyphens)


def words(normalized: str) -> str:
    """Tokens without stop words, repeats kept."""
    return f"list_filter(string_split({normalized}, ' '), lambda t: t <> '' and not list_contains({STOP}, t))"


def bare(normalized: str) -> str:
    kept = f"array_to_string({words(normalized)}, ' ')"
    return f"CASE WHEN {kept} <> '' THEN {kept} ELSE {normalized} END"


def normalize_doi(x: str) -> str:
    v = f"trim({rx(f'trim({x})', '^[<(\\[{' + chr(34) + chr(39) + ']+', '')})"
    v = f"trim({rx(v, '>+$', '')})"
    v = rx(v, r"(?i)^(?:https?://(?:dx\.|www\.)?|(?:dx\.)?)doi\.org/", "")
    for p in ("(?i)^info:doi/", "(?i)^urn:doi:", r"(?i)^doi\s*:\s*"):
        v = rx(v, p, "")
    v = rx(f"url_decode(trim({v}))", r"(?s)[?#].*", "")
    v = "lower(trim(" + rx(v, r"[.,;:)\]}" + '"' + r"']+$", "") + "))"
    return f"CASE WHEN regexp_full_match({v}, {q(DOI_BODY)}) THEN {v} END"


def round_score(x: str) -> str:
    return f"floor(greatest(0.0::DOUBLE, least(1.0::DOUBLE, ({x})::DOUBLE)) * 10000.0::DOUBLE + 0.5::DOUBLE) / 10000.0::DOUBLE"


def bigrams(x: str) -> str:
    return f"list_distinct(list_transform(range(1, greatest(length({x}), 1)), lambda i: substr({x}, i, 2)))"


def jaccard(a: str, b: str) -> str:
    n = f"len(list_intersect({a}, {b}))"
    return f"CASE WHEN len({a}) = 0 OR len({b}) = 0 THEN 0.0::DOUBLE ELSE {n}::DOUBLE / (len({a}) + len({b}) - {n}) END"
