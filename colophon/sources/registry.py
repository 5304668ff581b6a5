"""The dimension of sources: roles in order, availability, traffic policy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import DEFAULT, EngineConfig

# Key -> display name of every source.
NAMES = {
    "doaj": "DOAJ", "pubmed": "PubMed Central", "core": "CORE", "arxiv": "arXiv", "semanticScholar": "Semantic Scholar",
    "crossref": "Crossref", "openalex": "OpenAlex", "europepmc": "Europe PMC", "datacite": "DataCite", "unpaywall": "Unpaywall",
}
# Default order of the sources in each role.
ROLES = {
    "primary": ("doaj", "pubmed", "core", "arxiv", "semanticScholar"),
    "fallback": ("crossref", "openalex"),
    "extended": ("europepmc", "datacite"),
    "similar": ("semanticScholar", "openalex", "europepmc", "arxiv", "core"),
    "fulltext": ("europepmc", "unpaywall", "openalex", "pubmed", "core", "semanticScholar"),
}
# Requests per second, per minute, at once, retries; without and with a key.
LIMITS = {
    "doaj": (2.0, None, 2, 2), "pubmed": (3.0, None, 1, 2), "core": (1.0, 10, 1, 2), "arxiv": (1 / 3, None, 1, 2), "semanticScholar": (1.0, None, 1, 3),
    "crossref": (5.0, None, 2, 2), "openalex": (5.0, None, 2, 2), "europepmc": (2.0, None, 1, 2), "datacite": (2.0, None, 1, 2), "unpaywall": (5.0, None, 2, 2),
}
KEYED_LIMITS = {"pubmed": (10.0, None, 3, 2), "semanticScholar": (1.0, None, 2, 3), "core": (1.0, 60, 2, 2)}
# Id schemes each source answers.
ID_SCHEMES = {
    "pmid": ("pubmed",), "pmcid": ("pubmed",), "arxiv": ("arxiv", "semanticScholar"), "s2": ("semanticScholar",), "openalex": ("openalex",), "core": ("core",), "doaj": ("doaj",),
    "doi": ("doaj", "pubmed", "core", "arxiv", "semanticScholar", "crossref", "openalex", "europepmc", "datacite"),
}
PLACEHOLDER_EMAIL = r"(?i)@(?:example|test|localhost|invalid|sample)\.|^(?:you|your|me|test|qa|noreply)@"


def is_placeholder_email(c: Column) -> Column:
    return F.coalesce(F.regexp_like(F.trim(c), F.lit(PLACEHOLDER_EMAIL)), F.lit(True)) | (F.trim(c) == "")


def sources(spark: SparkSession, config: EngineConfig = DEFAULT, roles: dict | None = None, keys: frozenset[str] = frozenset()) -> DataFrame:
    """(role, ordinal, source_key, source_name, available, reason). Unknown keys are left out, each role is cut to its budget."""
    cap = {"primary": config.max_primary, "fallback": config.max_fallback, "extended": config.max_extended}
    rows = []
    for role, order in (roles or ROLES).items():
        known = [k for k in order if k in NAMES][: cap.get(role)]
        for n, k in enumerate(known):
            reason = None
            if k == "core" and not (config.has_core_key or "core" in keys):
                reason = "an API key is required"
            if k == "unpaywall" and not config.contact_email:
                reason = "a contact address is required"
            rows.append((role, n, k, NAMES[k], reason is None, reason))
    x = spark.createDataFrame(rows, "role string, ordinal int, source_key string, source_name string, available boolean, reason string")
    if config.contact_email:
        fake = is_placeholder_email(F.lit(config.contact_email)) & (F.col("source_key") == "unpaywall")
        x = x.withColumn("available", F.col("available") & ~fake).withColumn("reason", F.when(fake, "a contact address is required").otherwise(F.col("reason")))
    return x


def traffic_policy(spark: SparkSession, keys: frozenset[str] = frozenset()) -> DataFrame:
    """(source, per_second, per_minute, at_once, retries, capacity)."""
    rows = []
    for k, v in LIMITS.items():
        rps, rpm, at_once, retries = KEYED_LIMITS[k] if k in keys and k in KEYED_LIMITS else v
        rows.append((k, rps, rpm, at_once, retries, max(1.0, min(rps, float(at_once)))))
    return spark.createDataFrame(rows, "source string, per_second double, per_minute int, at_once int, retries int, capacity double")


def result_limit(requested: Column, most: int) -> Column:
    return F.greatest(F.lit(1), F.least(F.coalesce(requested, F.lit(most)), F.lit(most)))
