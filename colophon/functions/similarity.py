"""Similarities of strings, sets and records. Strings are expected in normalized form, so units are ASCII characters."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .core import clamp01, let, round_score
from .text import STOP_WORDS

# Weights of the title blend, and of a dropped subtitle.
W_TOKENS, W_BIGRAMS, W_EDITS = 0.45, 0.35, 0.2
PREFIX_LENGTH, PREFIX_SCORE = 20, 0.9
# Weights of the match components without a DOI, of the similarity components, and of relations.
MATCH_WEIGHTS = {"title": 0.55, "author": 0.25, "year": 0.08, "venue": 0.05, "keyword": 0.07}
SIMILARITY_WEIGHTS = {"title": 0.4, "abstract": 0.3, "keywords": 0.2, "topics": 0.1}
RECENCY_YEARS = 12
RELATION = {"cites": 0.06, "cited": 0.06, "coupled": 0.04, "venue": 0.02, "cap": 0.1}


def levenshtein_similarity(a: Column, b: Column) -> Column:
    """1 less distance over the longer length; both empty 1, one empty 0."""
    longer = F.greatest(F.length(a), F.length(b))
    return F.when(longer == 0, F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), F.lit(1.0) - F.levenshtein(a, b).cast("double") / longer))


def banded_levenshtein(a: Column, b: Column, band: int) -> Column:
    """Distance, or band + 1 beyond the band."""
    d = F.levenshtein(a, b, band)
    return F.when(d < 0, F.lit(band + 1)).otherwise(d)


def jaccard(a: Column, b: Column) -> Column:
    """Of arrays without repeats; 0 if either is empty or NULL."""
    empty = (F.coalesce(F.size(a), F.lit(0)) <= 0) | (F.coalesce(F.size(b), F.lit(0)) <= 0)
    return F.when(empty, F.lit(0.0)).otherwise(let(F.size(F.array_intersect(a, b)), lambda n: n.cast("double") / (F.size(a) + F.size(b) - n)))


def overlap_coefficient(a: Column, b: Column) -> Column:
    empty = (F.coalesce(F.size(a), F.lit(0)) <= 0) | (F.coalesce(F.size(b), F.lit(0)) <= 0)
    return F.when(empty, F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)).cast("double") / F.least(F.size(a), F.size(b)))


def bigrams(c: Column) -> Column:
    """Set of neighbouring character pairs, blanks included."""
    return F.when(F.length(c) < 2, F.array().cast("array<string>")).otherwise(
        F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(c) - 1)), lambda i: F.substring(c, i, F.lit(2))))
    )


def dice_of_sets(a: Column, b: Column) -> Column:
    total = F.size(a) + F.size(b)
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(2.0 * F.size(F.array_intersect(a, b)) / total)


def dice(a: Column, b: Column) -> Column:
    return F.when((a == "") | (b == ""), F.lit(0.0)).when(a == b, F.lit(1.0)).otherwise(dice_of_sets(bigrams(a), bigrams(b)))


def content_tokens(normalized: Column) -> Column:
    """Set of a normalized title's words without stop words."""
    stop = F.array(*[F.lit(w) for w in STOP_WORDS])
    return F.array_distinct(F.filter(F.split(normalized, " "), lambda t: (t != "") & ~F.array_contains(stop, t)))


def title_similarity(a: Column, b: Column, tokens_a: Column | None = None, tokens_b: Column | None = None, grams_a: Column | None = None, grams_b: Column | None = None) -> Column:
    """Blend of word overlap, bigram overlap and edit similarity of two normalized titles. Token and bigram sets
    may be passed in where they are columns already."""
    ta, tb = (content_tokens(a) if tokens_a is None else tokens_a), (content_tokens(b) if tokens_b is None else tokens_b)
    ga, gb = (bigrams(a) if grams_a is None else grams_a), (bigrams(b) if grams_b is None else grams_b)
    blend = F.lit(W_TOKENS) * jaccard(ta, tb) + F.lit(W_BIGRAMS) * dice_of_sets(ga, gb) + F.lit(W_EDITS) * levenshtein_similarity(a, b)
    short = F.least(F.length(a), F.length(b))
    starts = F.when(F.length(a) <= F.length(b), F.startswith(b, a)).otherwise(F.startswith(a, b))
    floor = F.when((short >= PREFIX_LENGTH) & starts, F.lit(PREFIX_SCORE)).otherwise(F.lit(0.0))
    return F.when((a == "") | (b == "") | a.isNull() | b.isNull(), F.lit(0.0)).when(a == b, F.lit(1.0)).otherwise(clamp01(F.greatest(blend, floor)))


def term_counts(terms: Column) -> Column:
    """Map term -> count of a bag: in the sorted bag a term's count is the distance to the next term."""

    def runs(s: Column) -> Column:
        def count(d: Column) -> Column:
            at = F.transform(d, lambda t: F.array_position(s, t))
            ends = let(at, lambda p: F.transform(p, lambda x, i: (F.coalesce(F.try_element_at(p, (i + 2).cast("int")), (F.size(s) + 1).cast("bigint")) - x).cast("int")))
            return F.map_from_arrays(d, ends)

        return let(F.array_distinct(s), count)

    return let(F.array_sort(F.array_compact(terms)), runs)


def cosine(a: Column, b: Column) -> Column:
    """Of two term-count maps; 0 if either is empty. Only common terms are looked up."""
    norm = lambda m: F.sqrt(F.aggregate(F.map_values(m), F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    common = F.array_intersect(F.map_keys(a), F.map_keys(b))
    dot = F.aggregate(common, F.lit(0.0), lambda s, k: s + F.try_element_at(a, k).cast("double") * F.try_element_at(b, k).cast("double"))
    empty = (F.coalesce(F.size(a), F.lit(0)) <= 0) | (F.coalesce(F.size(b), F.lit(0)) <= 0)
    return F.when(empty, F.lit(0.0)).otherwise(clamp01(dot / (norm(a) * norm(b))))


def weighted_mean(parts: list[tuple[float, Column]]) -> Column:
    """Over the parts that apply: a NULL part gives its weight to the others. 0 if none applies."""
    weight = sum((F.when(v.isNotNull(), F.lit(w)).otherwise(F.lit(0.0)) for w, v in parts), F.lit(0.0))
    total = sum((F.coalesce(F.lit(w) * v, F.lit(0.0)) for w, v in parts), F.lit(0.0))
    return F.when(weight > 0, clamp01(total / weight)).otherwise(F.lit(0.0))


def recency_bonus(year: Column, most: float, as_of_year: int) -> Column:
    """Falls linearly to 0 over the recency window; later years count in full, NULL counts 0."""
    age = F.lit(as_of_year) - year
    linear = F.lit(most) * (F.lit(1.0) - age.cast("double") / F.lit(float(RECENCY_YEARS)))
    return F.when(F.lit(most <= 0) | year.isNull() | (age >= RECENCY_YEARS), F.lit(0.0)).when(age <= 0, F.lit(most)).otherwise(linear)


def relation_bonus(doi_a: Column, refs_a: Column, venue_a: Column, doi_b: Column, refs_b: Column, venue_b: Column) -> Column:
    """One cites the other, both cite three of the same, or they share a venue; capped."""
    cites = F.coalesce(F.array_contains(refs_a, doi_b), F.lit(False))
    cited = F.coalesce(F.array_contains(refs_b, doi_a), F.lit(False))
    coupled = F.coalesce((F.size(F.array_distinct(refs_a)) >= 3) & (F.size(F.array_distinct(refs_b)) >= 3) & (F.size(F.array_intersect(refs_a, refs_b)) >= 3), F.lit(False))
    venue = F.coalesce((venue_a != "") & (venue_a == venue_b), F.lit(False))
    bonus = F.lit(0.0)
    for name, holds in (("cites", cites), ("cited", cited), ("coupled", coupled), ("venue", venue)):
        bonus = bonus + F.when(holds, F.lit(RELATION[name])).otherwise(F.lit(0.0))
    return F.least(bonus, F.lit(RELATION["cap"]))


__all__ = [n for n in dir() if not n.startswith("_")] + ["round_score"]
