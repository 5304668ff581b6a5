"""Personal names: parsing into surname and given part, and how far two lists agree."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .core import blank_to_null, col, collapse, js_trim, let
from .text import fold_accents

# Words that belong to the surname that follows, and suffixes that belong to no name.
PARTICLES = "al bin da de del della den der di dos du el ibn la le mac mc op st ten ter van von".split()
SUFFIXES = "jr sr ii iii iv phd md msc bsc dr prof".split()

AUTHOR = "struct<full:string,last:string,first_initial:string>"


def _tokens(c: Column) -> Column:
    letters = F.regexp_replace(F.lower(fold_accents(c)), "[^a-z]+", " ")
    return F.filter(F.split(letters, " "), lambda t: (t != "") & ~t.isin(*SUFFIXES))


def _head(arr: Column, n: Column | int) -> Column:
    return F.slice(arr, F.lit(1), F.greatest(F.lit(0), F.lit(n) if isinstance(n, int) else n))


def _tail(arr: Column, start: Column) -> Column:
    return F.slice(arr, start, F.greatest(F.lit(0), F.size(arr) - start + 1))


def _western(tokens: Column) -> Column:
    """(surname, given) of a name without a comma."""

    def body(t: Column) -> Column:
        n = F.size(t)
        last, first = F.element_at(t, -1), F.element_at(t, 1)
        initials_last = (F.length(last) <= 2) & (F.length(first) > 2)
        # particles in front of the last token, counted from the right
        run = F.aggregate(
            F.reverse(_head(t, n - 1)),
            F.struct(F.lit(0).alias("n"), F.lit(True).alias("open")),
            lambda acc, x: F.struct(
                F.when(acc["open"] & x.isin(*PARTICLES), acc["n"] + 1).otherwise(acc["n"]).alias("n"), (acc["open"] & x.isin(*PARTICLES)).alias("open")
            ),
        )["n"]
        cut = n - 1 - run
        return (
            F.when(n <= 1, F.struct(t.alias("sur"), _head(t, 0).alias("given")))
            .when(initials_last, F.struct(_head(t, n - 1).alias("sur"), _tail(t, n).alias("given")))
            .otherwise(F.struct(_tail(t, cut + 1).alias("sur"), _head(t, cut).alias("given")))
        )

    # element_at on an empty array is an error, so nothing but a blank name gets a dummy token
    return let(F.when(F.size(tokens) > 0, tokens), lambda t: F.when(t.isNotNull(), body(t)))


def normalize_author(c: Column | str) -> Column:
    """struct(full, last, first_initial); NULL when nothing usable is left."""

    def split(raw: Column) -> Column:
        at = F.instr(raw, ",")
        comma = F.struct(_tokens(F.substring(raw, F.lit(1), at - 1)).alias("sur"), _tokens(F.substring(raw, at + 1, F.length(raw))).alias("given"))
        return F.when(at > 1, comma).otherwise(_western(_tokens(raw)))

    def repair(p: Column) -> Column:
        n = F.size(p["given"])
        moved = F.struct(_tail(p["given"], F.greatest(n, F.lit(1))).alias("sur"), _head(p["given"], n - 1).alias("given"))
        return F.when(F.size(p["sur"]) > 0, p).when(n > 0, moved)

    def build(p: Column) -> Column:
        return F.when(
            p.isNotNull(),
            F.struct(
                F.array_join(F.concat(p["given"], p["sur"]), " ").alias("full"),
                F.array_join(p["sur"], " ").alias("last"),
                F.substring(F.try_element_at(p["given"], F.lit(1)), 1, 1).alias("first_initial"),
            ),
        )

    return let(let(let(js_trim(col(c)), split), repair), build)


def normalize_authors(arr: Column | str) -> Column:
    """Parsed names, the first of each surname and initial. NULL gives []."""
    parsed = F.array_compact(F.transform(F.coalesce(col(arr), F.array().cast("array<string>")), normalize_author))

    def first_of_each(p: Column) -> Column:
        keys = F.transform(p, lambda a: F.concat(a["last"], F.lit("|"), F.coalesce(a["first_initial"], F.lit(""))))
        return let(F.struct(p.alias("p"), keys.alias("k")), lambda s: F.transform(F.array_distinct(s["k"]), lambda k: F.element_at(s["p"], F.array_position(s["k"], k).cast("int"))))

    return let(parsed, first_of_each)


def author_similarity(a: Column, b: Column) -> Column:
    """0 other surname, 1 same name, .9 same initial, .2 other initial, .75 an initial is missing."""
    return (
        F.when(a["last"] != b["last"], F.lit(0.0))
        .when(a["full"] == b["full"], F.lit(1.0))
        .when(a["first_initial"].isNull() | b["first_initial"].isNull(), F.lit(0.75))
        .when(a["first_initial"] == b["first_initial"], F.lit(0.9))
        .otherwise(F.lit(0.2))
    )


def author_overlap(a: Column, b: Column) -> Column:
    """One-to-one alignment, driven by the shorter list, each name with its best free partner (the first among equals)."""

    def align(s: Column) -> Column:
        short, long = s["short"], s["long"]

        def step(acc: Column, x: Column) -> Column:
            scores = F.transform(long, lambda y, i: F.when(F.array_contains(acc["used"], i), F.lit(-1.0)).otherwise(author_similarity(x, y)))
            return let(
                scores,
                lambda v: let(
                    F.array_max(v),
                    lambda best: F.struct(
                        (acc["total"] + F.greatest(best, F.lit(0.0))).alias("total"),
                        F.when(best > 0, F.concat(acc["used"], F.array((F.array_position(v, best) - 1).cast("int")))).otherwise(acc["used"]).alias("used"),
                    ),
                ),
            )

        start = F.struct(F.lit(0.0).alias("total"), F.array().cast("array<int>").alias("used"))
        return F.when((F.size(short) == 0) | (F.size(long) == 0), F.lit(0.0)).otherwise(F.aggregate(short, start, step)["total"] / F.size(short))

    swap = F.size(a) <= F.size(b)
    return let(F.struct(F.when(swap, a).otherwise(b).alias("short"), F.when(swap, b).otherwise(a).alias("long")), align)


def display_name(c: Column | str) -> Column:
    """'Family, Given' -> 'Given Family', white space tidied; NULL for blanks."""

    def flip(v: Column) -> Column:
        at = F.instr(v, ",")
        family, given = js_trim(F.substring(v, F.lit(1), at - 1)), js_trim(F.substring(v, at + 1, F.length(v)))
        return F.when((at > 1) & (family != "") & (given != ""), F.concat_ws(" ", given, family)).otherwise(blank_to_null(v))

    return let(collapse(col(c)), flip)


def clean_authors(arr: Column | str) -> Column:
    """Display names, first of each without regard to case. NULL gives []."""
    from .core import ordered_distinct

    return ordered_distinct(F.transform(F.coalesce(col(arr), F.array().cast("array<string>")), display_name))
