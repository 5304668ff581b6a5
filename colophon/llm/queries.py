"""Registered queries of the training-data operators. Every query reads its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table
from . import charforms, consensus, leakage, mojibake, names, retrieval, setjoin, tokenize


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return consensus.survivors(table(spark, d, "merge_groups"), table(spark, d, "papers"), table(spark, d, "paper_sources"))


def p1_merged(spark: SparkSession, d: str) -> DataFrame:
    return consensus.merged_records(table(spark, d, "merge_groups"), table(spark, d, "papers"), table(spark, d, "paper_sources"))


def p2_clusters(spark: SparkSession, d: str) -> DataFrame:
    return names.clusters(table(spark, d, "papers"), table(spark, d, "crossref_authors"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return names.variant_pairs(table(spark, d, "papers"), table(spark, d, "crossref_authors"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return setjoin.similar_pairs(setjoin.bibliographic_sets(table(spark, d, "papers"), table(spark, d, "build_inputs")))


def p3_classes(spark: SparkSession, d: str) -> DataFrame:
    return setjoin.class_links(setjoin.bibliographic_sets(table(spark, d, "papers"), table(spark, d, "build_inputs")))


def p4_matches(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.matches(table(spark, d, "repository_items"), table(spark, d, "papers"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return p4_matches(spark, d).select("record_id", "item_id")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return charforms.affected_fields(table(spark, d, "papers"))


def p5_forms(spark: SparkSession, d: str) -> DataFrame:
    return charforms.canonical_forms(table(spark, d, "papers"))


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokenize.encode_corpus(table(spark, d, "documents"))


def p7_leaks(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return p7_leaks(spark, d).select("eval_id", "doc_id")


def p8_restored(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return mojibake.repair(docs, mojibake.train(docs))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return p8_restored(spark, d).select("doc_id")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for k, v in globals().items() if k[0] == "p" and k[1:2].isdigit()}


def oracle_sql() -> dict[str, str]:
    return {}
