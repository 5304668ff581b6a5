"""Request and identifier validation, and the one-line query language."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.core import blank_to_null, collapse, js_trim, let
from ..functions.identifiers import normalize_doi
from ..functions.text import sanitize_text

# Limits of a request.
LIMITS = {"title": 500, "author": 200, "keyword": 100, "doi": 300, "authors": 20, "keywords": 20, "id": 300}
MIN_YEAR = 1500
# Shape of the value of each identifier scheme.
ID_SHAPES = {
    "pmid": r"^\d{1,9}$", "pmcid": r"(?i)^PMC\d{1,9}$", "arxiv": r"(?i)^(?:\d{4}\.\d{4,5}(?:v\d+)?|[a-z-]+(?:\.[A-Za-z]{2})?/\d{7}(?:v\d+)?)$",
    "openalex": r"(?i)^W\d{4,12}$", "s2": r"(?i)^[0-9a-f]{40}$", "core": r"^\d{1,12}$", "doaj": r"(?i)^[a-z0-9]{8,64}$",
}


def request_errors(as_of_year: int) -> Column:
    """Array of complaints about a request row (title, authors, keywords, doi, from_year, to_year); empty if it is fine."""
    long_item = lambda c, n: F.exists(F.coalesce(c, F.array().cast("array<string>")), lambda x: F.length(x) > n)
    size = lambda c: F.coalesce(F.size(c), F.lit(0))
    some = lambda c: sanitize_text(F.coalesce(c, F.lit(""))) != ""
    filled = lambda c: F.exists(F.coalesce(c, F.array().cast("array<string>")), lambda x: sanitize_text(x) != "")
    years = F.lit(as_of_year + 2)
    bad_year = lambda c: c.isNotNull() & ~c.between(F.lit(MIN_YEAR), years)
    title, authors, keywords, doi, low, high = (F.col(c) for c in ("title", "authors", "keywords", "doi", "from_year", "to_year"))
    checks = [
        (F.length(title) > LIMITS["title"], "title too long"),
        (size(authors) > LIMITS["authors"], "too many authors"),
        (long_item(authors, LIMITS["author"]), "author too long"),
        (size(keywords) > LIMITS["keywords"], "too many keywords"),
        (long_item(keywords, LIMITS["keyword"]), "keyword too long"),
        (F.length(doi) > LIMITS["doi"], "doi too long"),
        (some(doi) & normalize_doi(doi).isNull(), "doi not recognised"),
        (bad_year(low), "from_year out of range"),
        (bad_year(high), "to_year out of range"),
        (low > high, "from_year after to_year"),
        (~(some(title) | filled(authors) | filled(keywords) | some(doi)), "no search field"),
    ]
    return F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(m)) for c, m in checks]))


def paper_id_parts(c: Column | str) -> Column:
    """struct(scheme, value, error) of '<scheme>:<value>'."""
    raw = F.col(c) if isinstance(c, str) else c
    bad = lambda m: F.struct(F.lit(None).cast("string").alias("scheme"), F.lit(None).cast("string").alias("value"), F.lit(m).alias("error"))
    ok = lambda s, v: F.struct(s.alias("scheme"), v.alias("value"), F.lit(None).cast("string").alias("error"))

    def parse(d: Column) -> Column:
        at = F.instr(d, ":")
        scheme, value = F.lower(F.substring(d, F.lit(1), at - 1)), sanitize_text(F.substring(d, at + 1, F.length(d)))
        shaped = F.lit(False)
        for s, p in ID_SHAPES.items():
            shaped = shaped | ((scheme == s) & F.regexp_like(value, F.lit(p)))
        folded = F.when(scheme.isin("pmcid", "openalex"), F.upper(value)).when(scheme == "s2", F.lower(value)).otherwise(value)
        return (
            F.when(at <= 1, bad("not <scheme>:<value>"))
            .when(~scheme.isin("doi", *ID_SHAPES), bad("unsupported scheme"))
            .when(value == "", bad("empty value"))
            .when((scheme == "doi") & normalize_doi(value).isNull(), bad("malformed value"))
            .when(scheme == "doi", ok(scheme, normalize_doi(value)))
            .when(~shaped, bad("malformed value"))
            .otherwise(ok(scheme, folded))
        )

    decoded = F.try_url_decode(F.replace(raw, F.lit("+"), F.lit("%2B")))
    return (
        F.when(raw.isNull() | (js_trim(raw) == ""), bad("id required"))
        .when(F.length(raw) > LIMITS["id"], bad("id too long"))
        .when(decoded.isNull(), bad("invalid URL encoding"))
        .otherwise(let(js_trim(decoded), parse))
    )


_YEARS = r"(?i)^years?\s*:\s*(\d{4})\s*-\s*(\d{4})$"
_YEAR = r"(?i)^(year|since|from|after|until|to|before)\s*:\s*(\d{4})$"
_PREFIX = r"(?i)^(doi|title|authors?|kw|keywords?)\s*:\s*(.+)$"


def _parts_of(line: Column) -> Column:
    return F.filter(F.transform(F.split(line, r"\s+\+\s+"), js_trim), lambda p: p != "")


def _list(v: Column, sep: str) -> Column:
    return F.filter(F.transform(F.split(v, sep), js_trim), lambda x: x != "")


def _kind(p: Column) -> Column:
    terms = _list(p, ",")
    short = F.forall(terms, lambda t: (F.size(F.split(t, r"\s+")) <= 3) & ~F.regexp_like(F.element_at(F.split(t, r"\s+"), 1), F.lit("(?i)^(?:a|an|the|and|or|of|for|with|in|on)$")))
    word = F.lower(F.regexp_extract(p, _PREFIX, 1))
    return (
        F.when(F.regexp_like(p, F.lit(_YEARS)) | F.regexp_like(p, F.lit(_YEAR)), "year")
        .when(word == "doi", "doi")
        .when(word == "title", "title:")
        .when(F.startswith(word, F.lit("author")), "author:")
        .when(word != "", "keyword:")
        .when(F.startswith(p, F.lit("@")), "@")
        .when(F.regexp_like(p, F.lit(r"(?:^|/)10\.\d{4,9}/")) | F.regexp_like(p, F.lit(r"(?i)^https?://(?:dx\.)?doi\.org/")), "doi bare")
        .when(F.contains(p, F.lit(",")) & (F.size(terms) >= 2) & short, "keywords bare")
        .otherwise("title bare")
    )


def parse_free_text(rows: DataFrame, column: str = "raw_query") -> DataFrame:
    """Adds title, authors, keywords, doi, from_year, to_year of a one-line query: parts joined by ' + ', @author,
    kw:/author:/title:/doi: prefixes, year filters, a bare DOI, a bare list of short terms, else title words."""
    parts = F.transform(_parts_of(F.coalesce(F.col(column), F.lit(""))), lambda p: F.struct(_kind(p).alias("k"), p.alias("p"), F.regexp_extract(p, _PREFIX, 2).alias("v")))
    x = rows.withColumn("_parts", parts)
    of = lambda *kinds: F.filter("_parts", lambda s: s["k"].isin(*kinds))
    value = lambda s: F.when(s["v"] != "", js_trim(s["v"])).otherwise(s["p"])
    last = lambda arr: F.try_element_at(F.reverse(arr), F.lit(1))
    authors = F.flatten(F.transform(of("author:", "@"), lambda s: F.when(s["k"] == "@", F.array(js_trim(F.substring(s["p"], F.lit(2), F.length(s["p"]))))).otherwise(_list(s["v"], ";"))))
    keywords = F.flatten(F.transform(of("keyword:", "keywords bare"), lambda s: _list(value(s), ",")))
    # an explicit title starts over, bare words add to what is there
    title = F.aggregate(
        of("title:", "title bare"), F.lit(None).cast("string"), lambda acc, s: F.when(s["k"] == "title:", js_trim(s["v"])).when(acc.isNull(), s["p"]).otherwise(F.concat_ws(" ", acc, s["p"]))
    )
    year = lambda s, lo: F.coalesce(
        F.regexp_extract(s["p"], _YEARS, 1 if lo else 2).try_cast("int"),
        F.when(F.lower(F.regexp_extract(s["p"], _YEAR, 1)).isin(*(("year", "since", "from", "after") if lo else ("year", "until", "to", "before"))), F.regexp_extract(s["p"], _YEAR, 2).try_cast("int")),
    )
    none = lambda arr: F.when(F.size(arr) > 0, arr)
    return x.select(
        *[c for c in rows.columns if c not in ("title", "authors", "keywords", "doi", "from_year", "to_year")],
        title.alias("title"), none(authors).alias("authors"), none(keywords).alias("keywords"), last(F.transform(of("doi", "doi bare"), value)).alias("doi"),
        last(F.array_compact(F.transform(of("year"), lambda s: year(s, True)))).alias("from_year"), last(F.array_compact(F.transform(of("year"), lambda s: year(s, False)))).alias("to_year"),
    )


def free_text_for_mode(mode: str, c: Column) -> dict[str, Column]:
    """Fields of a line typed in a fixed mode: title, author, keywords or doi; year filters may stand among its parts."""
    kept = F.array_join(F.filter(_parts_of(c), lambda p: _kind(p) != "year"), " ")
    rest = let(collapse(kept), blank_to_null)
    return {"title": {"title": rest}, "author": {"authors": _list(rest, ";")}, "keywords": {"keywords": _list(rest, ",")}, "doi": {"doi": rest}}[mode]
