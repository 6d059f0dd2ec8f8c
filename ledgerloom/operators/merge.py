"""Lineage-preserving merge of observations, with conflict sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.operators.shredding import financial_tables


def conflict_id(*parts: Column) -> Column:
    return F.concat(F.lit("cf_"), F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 12))


def financial_observations(artifacts: DataFrame) -> DataFrame:
    """Line items with a candidate, a value and a period, one row each, as (artifact, source, ..., value, currency, restated)."""
    attributes = F.transform("periods", lambda p: F.struct(p["period_id"].alias("period_id"), p["currency_reported"].alias("currency"), p["restated"].alias("restated")))
    items = financial_tables(artifacts.withColumn("_periods", attributes), ("artifact_id", "company_id", "run_id", "source_id", "_periods"))["line_items"]
    key = "normalized_candidate__taxonomy_key"
    period = F.element_at("_periods", F.col("period_pos") + 1)
    items = items.filter(F.col(key).isNotNull() & F.col("value_numeric").isNotNull() & F.col("period_pos").isNotNull())
    return items.select("company_id", "run_id", "artifact_id", "source_id", F.col("pos").alias("line_pos"), "scope", period["period_id"].alias("period_id"), F.col(key).alias("taxonomy_key"), F.col("value_numeric").alias("value"), period["currency"].alias("currency"), period["restated"].alias("restated"))


def _differs(column: str) -> Column:
    """More than one distinct value; null is a value of its own."""
    return F.coalesce(F.min(column) != F.max(column), F.lit(False)) | ((F.count(column) > 0) & (F.count(column) < F.count("*")))


def merge_financials(observations: DataFrame, keys: tuple[str, ...] = ("company_id", "run_id", "scope", "period_id", "taxonomy_key")) -> DataFrame:
    """One row per figure: its members, and the reason of the conflict or the merged value.

    Reasons in this order: currency_mismatch, restatement, source_authority_conflict.  Members are sorted by artifact
    and source; the array is as long as the figure has observations.
    """
    member = F.struct("artifact_id", "source_id", "line_pos", "value", "currency", "restated")
    merged = observations.groupBy(*keys).agg(_differs("currency").alias("c"), _differs("restated").alias("r"), _differs("value").alias("v"), F.array_sort(F.collect_list(member)).alias("members"))
    reason = F.when(F.col("c"), "currency_mismatch").when(F.col("r"), "restatement").when(F.col("v"), "source_authority_conflict")
    named = [F.coalesce(F.col(k), F.lit("None")) for k in ("scope", "period_id", "taxonomy_key")]
    value = F.when(reason.isNull(), F.element_at("members", 1)["value"])
    return merged.select(*keys, F.when(reason.isNotNull(), conflict_id(*named)).alias("conflict_id"), reason.alias("reason"), value.alias("value"), "members")


def product_observations(artifacts: DataFrame) -> DataFrame:
    """Entities with a candidate, one row each, of product artifacts (``entities``: array of structs); null elements are left out."""
    rows = artifacts.select("company_id", "run_id", "artifact_id", "source_id", F.explode("entities").alias("e")).filter("e.normalized_candidate is not null")
    return rows.select("company_id", "run_id", "artifact_id", "source_id", "e.entity_type", F.col("e.normalized_candidate.family").alias("family"), F.col("e.source_native_name").alias("name"), "e.lifecycle_status")


def merge_products(observations: DataFrame, keys: tuple[str, ...] = ("company_id", "run_id", "entity_type", "family")) -> DataFrame:
    """One row per product family with its members: merged if all lifecycles agree (null is a value), else a conflict.

    Members are sorted by artifact and source; the array is as long as the family has observations.
    """
    member = F.struct("artifact_id", "source_id", F.col("name").alias("value"), F.col("entity_type").alias("scope"), F.lit(None).cast("string").alias("period"))
    merged = observations.groupBy(*keys).agg(_differs("lifecycle_status").alias("c"), F.array_sort(F.collect_list(member)).alias("members"), F.min("lifecycle_status").alias("lifecycle_status"))
    return merged.select(*keys, F.when(F.col("c"), conflict_id(F.lit("product"), F.col("entity_type"), F.col("family"))).alias("conflict_id"), F.when(~F.col("c"), F.col("lifecycle_status")).alias("lifecycle_status"), "members")


def merged_output(financials: DataFrame, products: DataFrame) -> DataFrame:
    """(company_id, run_id, part, merged, conflicts, document): of each run and part how much merged and how much conflicts, and the rows as JSON in
    key order (as long as the run has figures)."""

    def part(name: str, df: DataFrame, keys: list[str]) -> DataFrame:
        own = F.to_json(F.struct(*[c for c in df.columns if c not in ("company_id", "run_id")]))
        rows = df.groupBy("company_id", "run_id").agg(F.count_if(F.col("conflict_id").isNull()).alias("merged"), F.count("conflict_id").alias("conflicts"), F.array_sort(F.collect_list(F.struct(*keys, own.alias("j")))).alias("l"))
        return rows.select("company_id", "run_id", F.lit(name).alias("part"), "merged", "conflicts", F.concat(F.lit("["), F.array_join(F.transform("l", lambda x: x["j"]), ","), F.lit("]")).alias("document"))

    return part("financial", financials, ["scope", "period_id", "taxonomy_key"]).unionByName(part("product", products, ["entity_type", "family"]))
