"""All pairs of records whose sets of values are similar (Jaccard), exactly.

Sets are reduced to classes of equal sets first. Each class gets a binary sketch: the lowest bits of 128
independent minhashes in two 64-bit words. Candidates come from a pigeonhole argument: two sets
of n and m values with Jaccard >= t share a value among the first n - ceil(t n) + 1 values of
either, if both list their values rarest first. Candidates whose sketches differ in more bits than the
calibrated Hamming radius are dropped before any set is fetched; the rest is verified on the sets.

The pigeonhole runs over the values themselves and not over segments of the code. At t = 0.6 a one-bit
minhash differs with probability 0.2, so a code segment long enough to be selective is damaged
almost always; README.md has the figures. The radius is the smallest that a pair at the threshold
exceeds with probability below ``miss`` (binomial tail), 10^-7 by default.

Results: NULL lists and NULL elements count as missing; sets under ``least`` values have no partner. Repeated
rows are one class and come out as pairs of ids. Empty tables give an empty table.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.identifiers import normalize_doi
from ..functions.text import normalize_keywords
from ..session import cut

BITS = 128
THRESHOLD = 0.6
LEAST = 4
MISS = 1e-7


def radius(threshold: float, miss: float = MISS, bits: int = BITS) -> int:
    """Smallest r with P(more than r of the bits differ) < miss for a pair at the threshold."""
    p = (1 - threshold) / 2
    tail, r = 1.0, -1
    while tail >= miss and r < bits:
        r += 1
        tail -= math.comb(bits, r) * p**r * (1 - p) ** (bits - r)
    return r


def _mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return x ^ (x >> np.uint64(32))


def sketch(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Two words per set of hashed values; every set must hold a value."""
    out = np.zeros((len(starts), BITS // 64), np.uint64)
    seeds = _mix(np.arange(1, BITS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    for k in range(BITS):
        low = np.minimum.reduceat(_mix(values ^ seeds[k]), starts)
        out[:, k // 64] |= ((low >> np.uint64(7)) & np.uint64(1)) << np.uint64(k % 64)
    return out


def doi_set(arr: Column) -> Column:
    return F.array_distinct(F.array_compact(F.transform(arr, normalize_doi)))


def classes(sets: DataFrame, least: int = LEAST) -> tuple[DataFrame, DataFrame]:
    """sets: field, id, values. -> (field, rep, values as sorted hashes), (field, rep, id)."""
    hashed = (
        sets.where(F.size("values") >= least)
        .select("field", "id", F.array_sort(F.transform("values", lambda v: F.xxhash64(v))).alias("values"))
        .withColumn("key", F.xxhash64("values"))
    )
    hashed = cut(hashed)
    reps = hashed.groupBy("field", "key").agg(F.min("id").alias("rep"))
    member = hashed.select("field", "key", "id").join(reps, ["field", "key"]).select("field", "rep", "id")
    distinct = hashed.join(reps.select("field", F.col("rep").alias("id")), ["field", "id"], "left_semi").select("field", F.col("id").alias("rep"), "values")
    return distinct, member


def prefix_rows(distinct: DataFrame, threshold: float) -> DataFrame:
    """(field, token, rep, n, lo, hi): the rarest values of each class with its sketch."""
    element = distinct.select("field", "rep", F.explode("values").alias("v"))
    df = element.groupBy("field", "v").agg(F.count("*").cast("int").alias("df"))
    # a value of one class only joins nothing, but it keeps its place in the order
    ordered = (
        element.join(df, ["field", "v"])
        .groupBy("field", "rep")
        .agg(F.array_sort(F.collect_list(F.struct("df", "v"))).alias("s"))
        .select("field", "rep", F.col("s.df").alias("df"), F.col("s.v").alias("v"))
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column("v")
            values = np.asarray(lists.flatten(), dtype=np.int64).view(np.uint64)
            df = np.asarray(b.column("df").flatten())
            n = np.asarray(pa.compute.list_value_length(lists)).astype(np.int64)
            if not len(n):
                continue
            starts = np.cumsum(n) - n
            code = sketch(values, starts).view(np.int64)
            p = n - np.ceil(threshold * n - 1e-9).astype(np.int64) + 1
            who = np.repeat(np.arange(len(n)), p)
            at = starts[who] + np.arange(len(who)) - np.repeat(np.cumsum(p) - p, p)
            shared = df[at] > 1
            who, at = who[shared], at[shared]
            yield pa.RecordBatch.from_arrays(
                [b.column("field").take(pa.array(who)), pa.array(values[at].view(np.int64)), b.column("rep").take(pa.array(who)), pa.array(n[who].astype(np.int32)), pa.array(code[who, 0]), pa.array(code[who, 1])],
                names=["field", "token", "rep", "n", "lo", "hi"],
            )

    return ordered.mapInArrow(run, "field string, token bigint, rep bigint, n int, lo bigint, hi bigint")


def similar_classes(distinct: DataFrame, threshold: float = THRESHOLD, miss: float = MISS) -> DataFrame:
    """(field, rep_a, rep_b, shared, n_a, n_b) with rep_a < rep_b."""
    rows = prefix_rows(distinct, threshold)
    a = rows.select("field", "token", *[F.col(c).alias(f"{c}_a") for c in ("rep", "n", "lo", "hi")])
    b = rows.select("field", "token", *[F.col(c).alias(f"{c}_b") for c in ("rep", "n", "lo", "hi")])
    differ = F.bit_count(F.col("lo_a").bitwiseXOR(F.col("lo_b"))) + F.bit_count(F.col("hi_a").bitwiseXOR(F.col("hi_b")))
    t = F.lit(threshold - 1e-9)
    near = (
        a.join(b, ["field", "token"])
        .where((F.col("rep_a") < F.col("rep_b")) & (F.col("n_a") >= t * F.col("n_b")) & (F.col("n_b") >= t * F.col("n_a")) & (differ <= radius(threshold, miss)))
        .select("field", "rep_a", "rep_b")
        .distinct()
    )
    left = distinct.select("field", F.col("rep").alias("rep_a"), F.col("values").alias("va"))
    right = distinct.select("field", F.col("rep").alias("rep_b"), F.col("values").alias("vb"))
    shared = F.size(F.array_intersect("va", "vb"))
    return (
        near.join(left, ["field", "rep_a"])
        .join(right, ["field", "rep_b"])
        .select("field", "rep_a", "rep_b", shared.alias("shared"), F.size("va").alias("n_a"), F.size("vb").alias("n_b"))
        .where(F.col("shared") >= t * (F.col("n_a") + F.col("n_b") - F.col("shared")))
    )


def bibliographic_sets(papers: DataFrame, inputs: DataFrame) -> DataFrame:
    return (
        papers.select(F.lit("keywords").alias("field"), F.col("record_id").alias("id"), normalize_keywords("keywords").alias("values"))
        .unionByName(inputs.select(F.lit("topics").alias("field"), F.col("input_id").alias("id"), normalize_keywords("topics").alias("values")))
        .unionByName(inputs.select(F.lit("reference_ids").alias("field"), F.col("input_id").alias("id"), doi_set(F.col("reference_ids")).alias("values")))
    )


def class_links(sets: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Compact form: one row per record with its class and the number of other records it is similar to."""
    distinct, member = classes(sets)
    size = member.groupBy("field", "rep").agg(F.count("*").alias("size"))
    pair = similar_classes(distinct, threshold).select("field", "rep_a", "rep_b")
    both = pair.unionByName(pair.select("field", F.col("rep_b").alias("rep_a"), F.col("rep_a").alias("rep_b")))
    other = both.join(size.withColumnRenamed("rep", "rep_b"), ["field", "rep_b"]).groupBy("field", F.col("rep_a").alias("rep")).agg(F.sum("size").alias("others"))
    per = size.join(other, ["field", "rep"], "left").select("field", "rep", (F.col("size") - 1 + F.coalesce("others", F.lit(0))).alias("links"))
    return member.join(per, ["field", "rep"]).select("field", "id", F.col("rep").alias("class_id"), "links")


def similar_pairs(sets: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(field, id_a, id_b), every pair of records once, equal sets included."""
    distinct, member = classes(sets)
    pair = similar_classes(distinct, threshold).select("field", "rep_a", "rep_b")
    a = member.select("field", F.col("rep").alias("rep_a"), F.col("id").alias("ida"))
    b = member.select("field", F.col("rep").alias("rep_b"), F.col("id").alias("idb"))
    across = pair.join(a, ["field", "rep_a"]).join(b, ["field", "rep_b"]).select("field", "ida", "idb")
    within = a.withColumnRenamed("rep_a", "rep").join(b.withColumnRenamed("rep_b", "rep"), ["field", "rep"]).where("ida < idb").select("field", "ida", "idb")
    return across.unionByName(within).select("field", F.least("ida", "idb").alias("id_a"), F.greatest("ida", "idb").alias("id_b"))
