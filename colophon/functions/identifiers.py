"""DOIs and the other identifier schemes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .core import WS, blank_to_null, col, js_trim, let

DOI_BODY = r"10\.\d{4,9}/[-._;()/:a-z0-9<>+\[\]]+"


# A value of this shape is changed by nothing but lower-casing.
_PLAIN = r"\A10\.\d{4,9}/[-._;()/:a-zA-Z0-9<>+\[\]]*[-_(/a-zA-Z0-9<+\[]\z"


def _full_doi(value: Column) -> Column:
    v = js_trim(value)
    v = js_trim(F.regexp_replace(F.regexp_replace(v, r"^[<(\[{\"']+", ""), ">+$", ""))
    v = F.regexp_replace(v, r"(?i)^(?:https?://(?:dx\.|www\.)?|(?:dx\.)?)doi\.org/", "")
    v = F.regexp_replace(v, "(?i)^info:doi/", "")
    v = F.regexp_replace(v, "(?i)^urn:doi:", "")
    v = js_trim(F.regexp_replace(v, f"(?i)^doi{WS}*:{WS}*", ""))
    v = let(
        v,
        lambda x: F.when(
            F.contains(x, F.lit("%")), F.coalesce(F.try_url_decode(F.replace(x, F.lit("+"), F.lit("%2B"))), x)
        ).otherwise(x),
    )
    v = F.regexp_replace(v, r"(?s)[?#].*\z", "")
    v = F.lower(js_trim(F.regexp_replace(v, r"[.,;:)\]}\"']+\z", "")))
    return let(v, lambda x: F.when(F.regexp_like(x, F.lit(rf"\A{DOI_BODY}\z")), x))


def normalize_doi(c: Column | str) -> Column:
    """Bare lower-case DOI, or NULL when the value isn't one."""
    return let(col(c), lambda x: F.when(F.regexp_like(x, F.lit(_PLAIN)), F.lower(x)).otherwise(_full_doi(x)))


def is_valid_doi(c: Column | str) -> Column:
    return normalize_doi(c).isNotNull()


def doi_equals(a: Column | str, b: Column | str) -> Column:
    return F.coalesce(normalize_doi(a) == normalize_doi(b), F.lit(False))


def doi_to_url(c: Column | str) -> Column:
    return F.concat(F.lit("https://doi.org/"), normalize_doi(c))


def extract_doi(c: Column | str) -> Column:
    """First DOI inside a longer text."""
    return normalize_doi(blank_to_null(F.regexp_extract(col(c), f"(?i){DOI_BODY}", 0)))


def strip_arxiv_version(c: Column | str) -> Column:
    return F.lower(F.regexp_replace(col(c), r"(?i)v\d+$", ""))


def normalize_arxiv_id(c: Column | str) -> Column:
    """Accepts abs/pdf URLs, an arXiv: prefix and a .pdf ending; NULL for anything that isn't an id."""
    v = js_trim(col(c))
    v = F.regexp_replace(v, r"(?i)^https?://(?:export\.|www\.)?arxiv\.org/(?:abs|pdf)/", "")
    v = F.regexp_replace(F.regexp_replace(v, "(?i)^arxiv:", ""), r"(?i)\.pdf$", "")
    return let(v, lambda x: F.when(F.regexp_like(x, F.lit(r"(?i)\A(?:\d{4}\.\d{4,5}|[a-z-]+(?:\.[a-z]{2})?/\d{7})(?:v\d+)?\z")), x))


def normalize_openalex_id(c: Column | str) -> Column:
    """W-id in upper case, bare or from a URL; ids of the other schemes that works may carry stay as they are."""

    def body(v: Column) -> Column:
        bare = blank_to_null(F.regexp_extract(v, r"(?i)^(?:.*openalex\.org/)?(w\d{4,12})", 1))
        whole = F.regexp_like(v, F.lit(r"(?i)^w\d{4,12}$")) | F.regexp_like(v, F.lit(r"(?i)openalex\.org/w\d{4,12}"))
        return F.when(whole, F.upper(bare)).when(F.regexp_like(v, F.lit("(?i)^(?:pmid|pmcid|doi|mag):")), v)

    return let(js_trim(col(c)), body)


def trailing_id(c: Column | str) -> Column:
    """What follows the last slash."""
    return blank_to_null(F.regexp_extract(col(c), r"([^/]+)/?$", 1))


def identity_keys(doi, pmcid, pmid, arxiv_id, source, source_id) -> Column:
    """Prefixed keys, strongest first: doi, pmcid, pmid, arxiv, source record."""
    some = lambda c: blank_to_null(col(c))
    return F.array_compact(
        F.array(
            F.concat(F.lit("doi:"), normalize_doi(doi)),
            F.concat(F.lit("pmcid:"), F.upper(some(pmcid))),
            F.concat(F.lit("pmid:"), some(pmid)),
            F.concat(F.lit("arxiv:"), strip_arxiv_version(some(arxiv_id))),
            F.concat(F.lit("src:"), col(source), F.lit(":"), some(source_id)),
        )
    )


# Sources whose own ids are public ids.
SOURCE_SCHEMES = {"Semantic Scholar": "s2", "OpenAlex": "openalex", "CORE": "core", "DOAJ": "doaj"}


def paper_id(doi, pmcid, pmid, arxiv_id, source, source_id) -> Column:
    """<scheme>:<value> of the strongest identifier."""
    some = lambda c: blank_to_null(col(c))
    scheme = F.try_element_at(F.create_map(*[F.lit(x) for kv in SOURCE_SCHEMES.items() for x in kv]), col(source))
    return F.coalesce(
        F.concat(F.lit("doi:"), normalize_doi(doi)),
        F.concat(F.lit("pmcid:"), some(pmcid)),
        F.concat(F.lit("pmid:"), some(pmid)),
        F.concat(F.lit("arxiv:"), some(arxiv_id)),
        F.concat(scheme, F.lit(":"), some(source_id)),
    )
