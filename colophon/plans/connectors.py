"""Second steps of source look-ups: which answer counts, id bridges, related works with a top-up.

Every step is a join or a window over slim columns; NULL keys never match, empty inputs give empty results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.identifiers import normalize_openalex_id
from .engine import lookup_first

# Most works in one batch of related ids, and most recommendations.
BATCH, MOST_RECOMMENDED = 50, 100


def own_doi(found: DataFrame) -> DataFrame:
    """found: lookup_id, asked, place, seq, n_doi -> the first answer that carries the asked DOI itself; answers that merely cite it don't count."""
    return found.where("n_doi = asked").groupBy("lookup_id").agg(F.min_by("seq", "place").alias("seq"))


def own_doi_first(found: DataFrame) -> DataFrame:
    """The first answer that carries the asked DOI, else the first answer."""
    order = F.struct((~F.coalesce(F.col("n_doi") == F.col("asked"), F.lit(False))).alias("other"), "place")
    return found.groupBy("lookup_id").agg(F.min_by("seq", order).alias("seq"))


def pmc_bridge(papers: DataFrame) -> DataFrame:
    """(identifier, pmcid): what a converter of identifiers answers, from the records that know both. One row per DOI or PMID."""
    known = papers.where("pmcid is not null and pmcid <> ''")
    ids = F.explode(F.array_compact(F.array(F.col("n_doi"), F.nullif("pmid", F.lit("")))))
    return known.select(ids.alias("identifier"), F.upper("pmcid").alias("pmcid")).groupBy("identifier").agg(F.min("pmcid").alias("pmcid"))


def with_pmcid(papers: DataFrame, bridge: DataFrame) -> DataFrame:
    """papers with ``found_pmcid``: their own, else the bridge's answer for the DOI, else (without a DOI) for the PMID."""
    asked = F.when(F.nullif("pmcid", F.lit("")).isNull(), F.coalesce("n_doi", F.nullif("pmid", F.lit(""))))
    b = bridge.select("identifier", F.col("pmcid").alias("bridged"))
    return papers.withColumn("identifier", asked).join(b, "identifier", "left").withColumn("found_pmcid", F.coalesce(F.upper(F.nullif("pmcid", F.lit(""))), "bridged")).drop("identifier", "bridged")


def strongest_id(own_source: str = "Semantic Scholar") -> Column:
    """The identifier to ask for recommendations by: the source's own id, DOI, arXiv id, PMID, PMCID."""
    some = lambda c: F.nullif(F.col(c), F.lit(""))
    return F.coalesce(
        F.when(F.col("source") == own_source, some("source_id")), *[F.concat(F.lit(f"{p}:"), some(c)) for p, c in (("DOI", "doi"), ("ARXIV", "arxiv_id"), ("PMID", "pmid"), ("PMCID", "pmcid"))]
    )


def recommended(mains: DataFrame, edges: DataFrame, limit: int) -> DataFrame:
    """mains: query_id, identifier; edges: identifier, dst, place -> (query_id, dst, rank)."""
    w = Window.partitionBy("query_id").orderBy("place", "dst")
    x = mains.join(edges, "identifier").withColumn("rank", F.row_number().over(w))
    return x.where(F.col("rank") <= min(limit, MOST_RECOMMENDED)).select("query_id", "dst", "rank")


def related_works(mains: DataFrame, edges: DataFrame, papers: DataFrame, limit: int) -> DataFrame:
    """(query_id, seq, route): works that a main work names as related, then a search by title and topics where they are fewer than ``limit``.

    mains: query_id, openalex_id, terms; edges: openalex_id, dst_id, place; papers: seq, openalex_id, terms."""
    most = min(limit, BATCH)
    by = Window.partitionBy("query_id").orderBy("place", "dst_id")
    named = mains.select("query_id", "openalex_id").join(edges, "openalex_id").withColumn("k", F.row_number().over(by)).where(F.col("k") <= most)
    ids = papers.where("openalex_id is not null").groupBy("openalex_id").agg(F.min("seq").alias("seq"))
    batch = named.select("query_id", normalize_openalex_id("dst_id").alias("openalex_id")).join(ids, "openalex_id").select("query_id", "seq").distinct()
    had = batch.groupBy("query_id").agg(F.count("*").alias("n"))
    short = mains.join(had, "query_id", "left").where(F.coalesce("n", F.lit(0)) < limit)
    more = lookup_first(short.where(F.size("terms") > 0).select(F.col("query_id").alias("aid"), "terms"), papers.select(F.col("seq").alias("rid"), "terms"), 0.5, min(2 * limit, BATCH))
    more = more.select(F.col("aid").alias("query_id"), F.col("rid").alias("seq"))
    return batch.withColumn("route", F.lit("related")).unionByName(more.join(batch, ["query_id", "seq"], "left_anti").withColumn("route", F.lit("search")))
