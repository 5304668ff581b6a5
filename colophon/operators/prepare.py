"""Derived columns that matching, ranking and deduplication share; computed once per record."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.authors import normalize_authors
from ..functions.core import blank_to_null, collapse, let
from ..functions.identifiers import normalize_doi
from ..functions.similarity import bigrams, content_tokens
from ..functions.text import keyword_tokens, normalize_keywords, normalize_title, title_fingerprint, title_tokens, without_stop_words, year_hint

EMPTY = "array<string>"


def _strings(c: str) -> Column:
    return F.coalesce(F.col(c), F.array().cast(EMPTY))


def prepare_papers(papers: DataFrame) -> DataFrame:
    """Adds n_title, n_tokens, n_grams, n_bare (no stop words), n_print, n_doi, n_authors, n_venue, n_words."""
    with_title = papers.withColumn("n_title", normalize_title("title"))
    return (
        with_title.withColumn("n_bare", without_stop_words(F.col("n_title")))
        .withColumn("n_tokens", content_tokens(F.col("n_title")))
        .withColumn("n_grams", bigrams(F.col("n_title")))
        .withColumn("n_print", title_fingerprint("title"))
        .withColumn("n_doi", normalize_doi("doi"))
        .withColumn("n_authors", normalize_authors("authors"))
        .withColumn("n_venue", normalize_title(F.coalesce("journal", "conference")))
        .withColumn("n_words", keyword_tokens(F.concat(_strings("keywords"), _strings("topics"), F.array("n_bare"))))
    )


def prepare_queries(queries: DataFrame, as_of_year: int) -> DataFrame:
    """queries: query_id, title, authors, keywords, doi, from_year, to_year -> normalized query with its strategy."""
    tidy = let(collapse(F.col("title")), blank_to_null)
    people = F.filter(F.transform(_strings("authors"), collapse), lambda a: a != "")
    x = (
        queries.withColumn("raw_title", F.col("title"))
        .withColumn("title", tidy)
        .withColumn("doi", normalize_doi("doi"))
        .withColumn("authors", people)
        .withColumn("keywords", normalize_keywords("keywords"))
    )
    return (
        x.withColumn("n_title", normalize_title("title"))
        .withColumn("title_tokens", title_tokens("title"))
        .withColumn("n_tokens", content_tokens(F.col("n_title")))
        .withColumn("n_grams", bigrams(F.col("n_title")))
        .withColumn("n_authors", normalize_authors("authors"))
        .withColumn("n_words", keyword_tokens("keywords"))
        .withColumn("year_hint", year_hint("raw_title", as_of_year))
        .withColumn("strategy", F.when(F.col("doi").isNotNull(), "doi").when(F.col("title").isNotNull(), "title").otherwise("keywords"))
    )


def prefixed(df: DataFrame, prefix: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """Columns renamed with a prefix, so both sides of a pair may hold any names, equal or not."""
    return df.select(*[F.col(f"`{c}`").alias(c if c in keep else f"{prefix}{c}") for c in df.columns])


def is_discovery(title: Column, doi: Column) -> Column:
    return title.isNull() & doi.isNull()
