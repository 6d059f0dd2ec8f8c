"""The source inventory of every run, from the event log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.operators.eventlog import entity_state

PRIORITIES = ["primary", "secondary", "signal"]
STATUSES = ["ok", "unavailable", "error"]
DIFF_CLASSES = ["unchanged", "cosmetic_change", "table_change", "content_change", "unavailable", "new"]
FIELDS = ["url", "source_class", "source_priority", "title", "publication_date", "content_hash", "retrieval_status", "diff_class", "notes"]


def _text(name: str, missing: str) -> Column:
    """Text of a payload field: ``missing`` where the key is absent, ``None`` where it is there and null."""
    return F.when(F.col(f"{name}.there"), F.coalesce(F.col(f"{name}.value"), F.lit("None"))).otherwise(missing)


def _filled(name: str) -> Column:
    return F.nullif(F.col(f"{name}.value"), F.lit(""))


def _coerce(name: str, valid: list[str], default: str) -> Column:
    return F.when(F.col(f"{name}.value").isin(valid), F.col(f"{name}.value")).otherwise(default)


def build_inventory(log: DataFrame, pos: str = "ingest_seq") -> DataFrame:
    """One row per (company, run, source): newest payload of the run, retrieval and sighting times over all runs.

    Payload fields are folded with one ``max_by`` each in one aggregate: no payload is exploded or collected.
    """
    keys = ["company_id", "run_id", "entity_id"]
    payload = F.from_json("payload", "map<string,string>")
    order = F.struct("event_time", "event_id", pos)
    folds = []
    for f in FIELDS:
        there = F.map_contains_key("p", F.lit(f))
        value = F.struct(there.alias("there"), F.col("p").getItem(f).alias("value"))
        folds.append(F.max_by(F.when(there, value), F.when(there, order)).alias(f))
    first_of_ties = F.struct("event_time", "event_id", -F.col(pos))
    run = log.withColumn("p", payload).groupBy(*keys).agg(*folds, F.max_by("event_type", first_of_ties).alias("latest"))
    history = log.groupBy("company_id", "entity_id").agg(F.max(F.when(F.col("event_type").isin("retrieved", "canonicalized"), F.col("event_time"))).alias("retrieved_at"))
    history = history.join(entity_state(log, pos=pos).drop("status"), ["company_id", "entity_id"])
    status = F.when(F.col("latest") == "unavailable", "unavailable").otherwise(_coerce("retrieval_status", STATUSES, "ok"))
    return run.join(history, ["company_id", "entity_id"], "left").select(
        "company_id", "run_id", F.col("entity_id").alias("source_id"), _text("url", "").alias("url"), _text("source_class", "unknown").alias("source_class"),
        _coerce("source_priority", PRIORITIES, "secondary").alias("source_priority"), _filled("title").alias("title"), _filled("publication_date").alias("publication_date"),
        "retrieved_at", "first_seen_at", "last_seen_at", _filled("content_hash").alias("content_hash"), status.alias("retrieval_status"),
        _coerce("diff_class", DIFF_CLASSES, "new").alias("diff_class"), _filled("notes").alias("notes"),
    )
