"""Registered queries of the language-model data operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm import entity_match, leakage, mixing, names, residue
from ledgerloom.session import table


def p6_matches(spark: SparkSession, folder: str) -> DataFrame:
    """The matched pairs with their confidence."""
    return entity_match.match(table(spark, folder, "registry_record"), table(spark, folder, "lei_record"))


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    return p6_matches(spark, folder).select("record_id", "lei")


def p7_entities(spark: SparkSession, folder: str) -> DataFrame:
    """Each readable list entry with the entity it belongs to."""
    return names.linked_entries(table(spark, folder, "sdn_entry"), table(spark, folder, "watchlist_entry"))


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    return names.same_entity_pairs(p7_entities(spark, folder))


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    return leakage.leaked_items(table(spark, folder, "documents"), table(spark, folder, "eval_item"))


def p8_items(spark: SparkSession, folder: str) -> DataFrame:
    """Report: test items that leaked and in how many documents."""
    return p8_found(spark, folder).groupBy("item_id").agg(F.count("*").alias("n_documents"))


def p9_mix(spark: SparkSession, folder: str) -> DataFrame:
    """The chosen documents with their number of uses."""
    return mixing.mix(table(spark, folder, "documents"), table(spark, folder, "mix_target"))


def p9_shares(spark: SparkSession, folder: str) -> DataFrame:
    """Report: each source's target and actual share."""
    return mixing.actual_shares(p9_mix(spark, folder), table(spark, folder, "mix_target"))


def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    return residue.residue_documents(table(spark, folder, "documents")).select("doc_id")


def p10_reasons(spark: SparkSession, folder: str) -> DataFrame:
    """Report: excluded documents by reason."""
    return residue.residue_documents(table(spark, folder, "documents")).groupBy("reason").agg(F.count("*").alias("n_documents"))


QUERIES = {f.__name__: f for f in (p6_found, p6_matches, p7_found, p7_entities, p8_found, p8_items, p9_mix, p9_shares, p10_found, p10_reasons)}
SQL: dict[str, str] = {}
