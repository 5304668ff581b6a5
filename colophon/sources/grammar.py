"""Each source's own search expression as a column over a query table (title, authors, keywords, doi, free_text).

A NULL expression means that the query holds nothing this source can search for.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.core import blank_to_null, collapse, js_trim, let
from ..functions.identifiers import normalize_doi


def escape_backslash(c: Column, n: int = 500) -> Column:
    return F.substring(collapse(F.regexp_replace(c, r'([\\"])', r"\\$1")), 1, n)


def blank_out(chars: str, n: int = 400) -> Callable[[Column], Column]:
    return lambda c: F.substring(collapse(F.regexp_replace(c, f"[{chars}]", " ")), 1, n)


@dataclass(frozen=True)
class Grammar:
    """Templates with %s; ``keyword`` also serves free text."""

    escape: Callable[[Column], Column]
    title: str
    author: str
    keyword: str
    doi: str | None = None
    doi_alone: bool = True


# The fields and quoting of each source's query language.
GRAMMARS = {
    "doaj": Grammar(escape_backslash, 'bibjson.title:"%s"', 'bibjson.author.name:"%s"', '"%s"', 'doi:"%s"', doi_alone=False),
    "pubmed": Grammar(blank_out(r'"\[\]():*~'), "%s[Title]", "%s[Author]", "%s[All Fields]", "%s[DOI]"),
    "core": Grammar(escape_backslash, 'title:"%s"', 'authors:"%s"', '"%s"', 'doi:"%s"'),
    "arxiv": Grammar(blank_out('"()'), 'ti:"%s"', 'au:"%s"', 'all:"%s"'),
    "europepmc": Grammar(blank_out('"():'), 'TITLE:"%s"', 'AUTH:"%s"', '"%s"', 'DOI:"%s"'),
    "datacite": Grammar(blank_out(r'\\\\"~^'), 'titles.title:"%s"', 'creators.name:"%s"', '"%s"', 'doi:"%s"'),
}


def _fill(template: str, value: Column) -> Column:
    head, tail = template.split("%s")
    return F.concat(F.lit(head), value, F.lit(tail))


def _items(c: str) -> Column:
    return F.filter(F.transform(F.coalesce(F.col(c), F.array().cast("array<string>")), js_trim), lambda x: x != "")


def fielded_expression(source: str) -> Column:
    g = GRAMMARS[source]
    some = lambda template, v: let(g.escape(v), lambda e: F.when(e != "", _fill(template, e)))
    title = F.when(F.col("title").isNotNull() & (F.col("title") != ""), some(g.title, F.col("title")))
    authors = F.transform(_items("authors"), lambda a: some(g.author, a))
    doi = some(g.doi, normalize_doi("doi")) if g.doi else F.lit(None).cast("string")
    fields = F.array_compact(F.concat(F.array(doi) if not g.doi_alone else F.array(F.lit(None).cast("string")), F.array(title), authors))
    words = F.array_compact(F.transform(_items("keywords"), lambda k: some(g.keyword, k)))
    free = some(g.keyword, js_trim(F.col("free_text")))
    text = (
        F.when(F.size(fields) > 0, F.array_join(fields, " AND ")).when(F.size(words) > 0, F.array_join(words, " AND ")).otherwise(free)
    )
    return F.coalesce(doi, text) if g.doi_alone and g.doi else text


def plain_text_expression(limit: int = 500) -> Column:
    """Title and authors, else keywords, else free text: for sources that take free text only."""
    first = F.concat(F.array_compact(F.array(blank_to_null(F.col("title")))), _items("authors"))
    parts = F.when(F.size(first) > 0, first).when(F.size(_items("keywords")) > 0, _items("keywords")).otherwise(F.array_compact(F.array("free_text")))
    return let(F.substring(collapse(F.array_join(parts, " ")), 1, limit), blank_to_null)


def crossref_expression() -> Column:
    cut = lambda c: F.substring(collapse(c), 1, 500)
    title = let(cut(F.col("title")), blank_to_null)
    author = let(cut(F.array_join(_items("authors"), " ")), blank_to_null)
    words = let(cut(F.array_join(_items("keywords"), " ")), blank_to_null)
    bibliographic = F.coalesce(title, F.when(author.isNull(), F.coalesce(words, let(cut(F.col("free_text")), blank_to_null))))
    parts = F.array_compact(F.array(F.concat(F.lit("query.bibliographic="), bibliographic), F.concat(F.lit("query.author="), author)))
    return let(F.array_join(parts, "&"), blank_to_null)


def openalex_expression() -> Column:
    safe = lambda c: F.substring(collapse(F.regexp_replace(c, "[,:|]", " ")), 1, 350)
    first = F.try_element_at(_items("authors"), F.lit(1))
    filters = F.concat(F.lit("filter=title.search:"), safe(F.col("title")), F.coalesce(F.concat(F.lit(",raw_author_name.search:"), safe(first)), F.lit("")))
    words = F.array_join(_items("keywords"), " ")
    text = F.when(words != "", words).otherwise(F.coalesce("free_text", F.array_join(_items("authors"), " ")))
    search = let(F.substring(collapse(text), 1, 350), lambda v: F.when(v != "", F.concat(F.lit("search="), v)))
    return F.when(F.col("title").isNotNull() & (F.col("title") != ""), filters).otherwise(search)


def arxiv_related_expression() -> Column:
    """First eight title words and the first category-shaped topic."""
    g = GRAMMARS["arxiv"]
    words = F.array_join(F.slice(F.split(F.col("title"), r"\s+"), 1, 8), " ")
    cat = F.try_element_at(F.filter(F.coalesce("topics", F.array().cast("array<string>")), lambda t: F.regexp_like(t, F.lit(r"^[a-z-]+(?:\.[A-Za-z-]+)?$"))), F.lit(1))
    parts = F.array_compact(F.array(F.when(words != "", _fill('all:"%s"', g.escape(words))), F.concat(F.lit("cat:"), g.escape(cat))))
    return let(F.array_join(parts, " AND "), blank_to_null)


def expression(source: str) -> Column:
    if source in GRAMMARS:
        return fielded_expression(source)
    return {"crossref": crossref_expression, "openalex": openalex_expression, "semanticScholar": plain_text_expression}[source]()


def query_string(params: list[tuple[str, Column]]) -> Column:
    """URL parameters; NULL and empty values are dropped."""
    parts = [F.when(v.isNotNull() & (v.cast("string") != ""), F.concat(F.lit(f"{k}="), F.url_encode(v.cast("string")))) for k, v in params]
    return F.concat_ws("&", *parts)
