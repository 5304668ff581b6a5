"""Similarity between a main paper and candidates, filters, orders and distinct titles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULT, EngineConfig
from ..functions.core import clamp01, round_score
from ..functions.identifiers import strip_arxiv_version
from ..functions.similarity import cosine, jaccard, recency_bonus, relation_bonus, term_counts, title_similarity, weighted_mean
from ..functions.text import keyword_tokens, normalize_title, term_list


def within_years(year: Column, low: Column, high: Column) -> Column:
    """No range keeps all; with a range an unknown year is out; bounds are inclusive."""
    inside = year.isNotNull() & (low.isNull() | (year >= low)) & (high.isNull() | (year <= high))
    return (low.isNull() & high.isNull()) | inside


def same_paper(a: str, b: str, config: EngineConfig = DEFAULT) -> Column:
    """Two DOIs decide alone; else any shared identifier, else equal titles without stop words."""
    x, y = (lambda n: F.col(f"{a}{n}")), (lambda n: F.col(f"{b}{n}"))
    some = lambda c: c.isNotNull() & (c != "")
    eq = lambda p, q: F.coalesce(some(p) & some(q) & (p == q), F.lit(False))
    titles = x("n_bare") == y("n_bare")
    if not config.empty_titles_are_equal:
        titles = titles & (x("n_bare") != "")
    other = (
        eq(F.upper(x("pmcid")), F.upper(y("pmcid")))
        | eq(x("pmid"), y("pmid"))
        | eq(strip_arxiv_version(x("arxiv_id")), strip_arxiv_version(y("arxiv_id")))
        | (F.coalesce(x("source") == y("source"), F.lit(False)) & eq(x("source_id"), y("source_id")))
        | titles
    )
    return F.when(some(x("doi")) & some(y("doi")), x("doi") == y("doi")).otherwise(other)


def similarity_columns(papers: DataFrame) -> DataFrame:
    """Adds what the similarity score compares beside the prepared columns."""
    topics = F.transform(F.coalesce("topics", F.array().cast("array<string>")), lambda t: normalize_title(t, remove_stop_words=True))
    return (
        papers.withColumn("v_terms", term_counts(term_list(F.coalesce("abstract", F.lit("")))))
        .withColumn("v_keywords", keyword_tokens("keywords"))
        .withColumn("v_topics", F.array_distinct(F.filter(topics, lambda t: t != "")))
    )


def coded_columns(papers: DataFrame) -> DataFrame:
    """What is only compared for equality as 64-bit codes, and of an abstract whether there is one: scored pairs move both sides' columns."""
    code = lambda c: F.transform(c, lambda x: F.xxhash64(x))
    sets = {n: code(n) for n in ("n_tokens", "n_grams", "v_keywords", "v_topics")}
    some = F.when(F.col("abstract") == "", F.lit("")).when(F.col("abstract").isNotNull(), F.lit("+"))
    return papers.withColumns({**sets, "v_terms": F.transform_keys("v_terms", lambda k, _: F.xxhash64(k)), "abstract": some})


def score_similarity(pairs: DataFrame, config: EngineConfig = DEFAULT, m: str = "m_", c: str = "c_") -> DataFrame:
    """Adds sim_title, sim_abstract, sim_keywords, sim_topics, relation_bonus and similarity."""
    x = lambda n: F.col(f"{m}{n}")
    y = lambda n: F.col(f"{c}{n}")
    some = lambda col: col.isNotNull() & (col != "")
    both = lambda n: (F.size(x(n)) > 0) & (F.size(y(n)) > 0)
    out = pairs.withColumns(
        {
            "sim_title": title_similarity(x("n_title"), y("n_title"), x("n_tokens"), y("n_tokens"), x("n_grams"), y("n_grams")),
            "sim_abstract": F.when(some(x("abstract")) & some(y("abstract")), cosine(x("v_terms"), y("v_terms"))),
            "sim_keywords": F.when(both("v_keywords"), jaccard(x("v_keywords"), y("v_keywords"))),
            "sim_topics": F.when(both("v_topics"), jaccard(x("v_topics"), y("v_topics"))),
            "relation_bonus": relation_bonus(x("doi"), x("reference_ids"), x("n_venue"), y("doi"), y("reference_ids"), y("n_venue")),
        }
    )
    w = config.similarity_weights
    mean = weighted_mean([(w[n], F.col(f"sim_{n}")) for n in ("title", "abstract", "keywords", "topics")])
    final = clamp01(mean + F.col("relation_bonus") + recency_bonus(y("year"), config.recency_boost, config.as_of_year))
    out = out.withColumn("similarity", round_score(final))
    return out.withColumns({n: round_score(F.col(n)) for n in ("sim_title", "sim_abstract", "sim_keywords", "sim_topics", "relation_bonus")})


def _rank(df: DataFrame, by: list[str], order: list[Column], name: str) -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))


def similar_order(c: str = "c_", seq: str = "seq") -> list[Column]:
    has_pdf = (F.coalesce(F.col(f"{c}pdf_url"), F.lit("")) != "").cast("int")
    zero = lambda n: F.coalesce(F.col(f"{c}{n}"), F.lit(0))
    return [F.col("similarity").desc(), has_pdf.desc(), zero("citation_count").desc(), zero("year").desc(), F.col(seq).asc()]


def discovery_order(c: str = "c_", seq: str = "seq", config: EngineConfig = DEFAULT) -> list[Column]:
    """Relevance plus an unclamped bonus for recent work, then sources, citations, year."""
    relevance = F.col("final_score") + recency_bonus(F.col(f"{c}year"), config.recency_boost, config.as_of_year)
    n_sources = F.coalesce(F.size(F.coalesce(F.col(f"{c}sources"), F.array(F.lit("")))), F.lit(1))
    zero = lambda n: F.coalesce(F.col(f"{c}{n}"), F.lit(0))
    return [relevance.desc(), n_sources.desc(), zero("citation_count").desc(), zero("year").desc(), F.col(seq).asc()]


def candidate_order(c: str = "c_", seq: str = "seq") -> list[Column]:
    n_sources = F.coalesce(F.size(F.coalesce(F.col(f"{c}sources"), F.array(F.lit("")))), F.lit(1))
    return [F.col("confidence").desc(), n_sources.desc(), F.coalesce(F.col(f"{c}citation_count"), F.lit(0)).desc(), F.col(seq).asc()]


def rank_distinct_titles(df: DataFrame, by: list[str], order: list[Column], limit: int, fingerprint: str = "c_n_print") -> DataFrame:
    """Ranks, keeps the first of each title fingerprint (empty ones are all kept), then the first ``limit``.

    The second window runs on the survivors only; both are partitioned by the same keys, so there is one exchange."""
    ranked = _rank(df, by, order, "raw_rank")
    first = F.row_number().over(Window.partitionBy(*by, fingerprint).orderBy("raw_rank"))
    kept = ranked.withColumn("nth", first).where((F.col("nth") == 1) | (F.col(fingerprint) == "")).drop("nth")
    return _rank(kept, by, [F.col("raw_rank").asc()], "rank").where(F.col("rank") <= limit).drop("raw_rank")


def rank_similar(pairs: DataFrame, by: list[str], limit: int, config: EngineConfig = DEFAULT) -> DataFrame:
    """pairs: m_*, c_*, from_year, to_year, seq. The most similar distinct titles of each main paper."""
    kept = pairs.where(~F.coalesce(same_paper("m_", "c_", config), F.lit(False)) & within_years(F.col("c_year"), F.col("from_year"), F.col("to_year")))
    return rank_distinct_titles(score_similarity(kept, config), by, similar_order(), limit)
