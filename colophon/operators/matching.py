"""Scoring of candidate records against described papers, and the verdict."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULT, EngineConfig
from ..functions.authors import author_overlap
from ..functions.core import round_score
from ..functions.similarity import MATCH_WEIGHTS, jaccard, title_similarity, weighted_mean
from ..functions.text import looks_distinctive

SCORES = ("doi", "title", "author", "year", "venue", "keyword")


def component_scores(q: str = "q_", c: str = "c_") -> dict[str, Column]:
    """The six components of a pair; NULL where the pair has nothing to compare."""
    col = lambda p, n: F.col(f"{p}{n}")
    gap = F.abs(col(c, "year") - col(q, "year_hint"))
    inside = F.contains(col(q, "n_title"), col(c, "n_venue"))
    return {
        "doi": F.when(col(q, "doi").isNotNull() & col(c, "n_doi").isNotNull() & (col(q, "doi") == col(c, "n_doi")), F.lit(1.0)).otherwise(F.lit(0.0)),
        "title": F.when(
            col(q, "title").isNotNull(),
            title_similarity(col(q, "n_title"), col(c, "n_title"), col(q, "n_tokens"), col(c, "n_tokens"), col(q, "n_grams"), col(c, "n_grams")),
        ),
        "author": F.when((F.size(col(q, "n_authors")) > 0) & (F.size(col(c, "n_authors")) > 0), author_overlap(col(q, "n_authors"), col(c, "n_authors"))),
        "year": F.when(gap == 0, F.lit(1.0)).when(gap == 1, F.lit(0.7)).when(gap > 1, F.lit(0.0)),
        "venue": F.when(col(q, "title").isNotNull() & (col(c, "n_venue") != "") & (col(q, "n_title") != "") & inside, F.lit(1.0)),
        "keyword": F.when((F.size(col(q, "n_words")) > 0) & (F.size(col(c, "n_words")) > 0), jaccard(col(q, "n_words"), col(c, "n_words"))),
    }


def evaluate(pairs: DataFrame, config: EngineConfig = DEFAULT, q: str = "q_", c: str = "c_") -> DataFrame:
    """Adds the scores (s_*), final_score, match_type, confidence and is_exact to every (query, candidate) pair."""
    x = pairs
    for name, value in component_scores(q, c).items():
        x = x.withColumn(f"s_{name}", value)
    x = x.withColumn("mean", weighted_mean([(w, F.col(f"s_{n}")) for n, w in MATCH_WEIGHTS.items()]))
    by_doi = F.col("s_doi") == 1.0
    same_title = F.coalesce((F.col(f"{q}n_title") != "") & (F.col(f"{q}n_title") == F.col(f"{c}n_title")), F.lit(False))
    gate = F.coalesce(F.col("s_title") >= config.title_exact, F.lit(False))
    named = F.size(f"{q}n_authors") > 0
    strong = named & (F.coalesce("s_author", F.lit(0.0)) >= F.when(same_title, F.lit(0.7)).otherwise(F.lit(0.8)))
    calm = F.col("s_year").isNull() | (F.col("s_year") != 0.0)
    exact = gate & strong & calm
    alone = same_title & ~named & calm & looks_distinctive(F.col(f"{q}n_title")) & (F.col("mean") >= config.exact)
    near = F.col(f"{q}title").isNotNull() & (F.col("mean") >= config.near_exact)
    akin = (F.coalesce("s_title", F.lit(0.0)) >= 0.5) | (F.coalesce("s_keyword", F.lit(0.0)) >= 0.5)
    kind = (
        F.when(by_doi | exact | alone, F.lit("exact")).when(near, F.lit("near-exact")).when(akin, F.lit("similar")).otherwise(F.lit("keyword"))
    )
    confidence = (
        F.when(by_doi, F.lit(0.99))
        .when(exact, F.greatest(F.lit(config.exact), F.least(F.lit(0.98), F.lit(0.9) + F.lit(0.08) * F.col("mean"))))
        .when(alone, F.greatest(F.lit(config.exact), F.col("mean")))
        .otherwise(F.col("mean"))
    )
    x = x.withColumns(
        {
            "match_type": kind,
            "confidence": round_score(confidence),
            "is_exact": by_doi | exact | alone,
            "final_score": round_score(F.when(by_doi, F.lit(1.0)).otherwise(F.col("mean"))),
        }
    )
    return x.withColumns({f"s_{n}": round_score(F.col(f"s_{n}")) for n in SCORES}).drop("mean")


def select_best(scored: DataFrame, by: list[str], seq: str = "seq") -> DataFrame:
    """The highest final score per group, the first among equals; none if it isn't above 0."""
    w = Window.partitionBy(*by).orderBy(F.col("final_score").desc(), F.col(seq).asc())
    return scored.withColumn("rn", F.row_number().over(w)).where((F.col("rn") == 1) & (F.col("final_score") > 0)).drop("rn")


def acceptable(match_type: Column, confidence: Column) -> Column:
    """A mere keyword match needs a confidence of .4."""
    return ~((match_type == "keyword") & (confidence < 0.4))
