"""Event log to state: one hash aggregate over the whole log, no replay.

Events are ordered by (event_time, event_id) as text, then by arrival.  The status needs only the last known event
and whether the entity was ever unavailable: if the last known event is an active one, any unavailable event came before.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ACTIVE = ["discovered", "retrieved", "canonicalized", "validated", "extracted"]


def order(pos: str) -> Column:
    return F.struct("event_time", "event_id", pos)


def _status(last: Column, gone: Column) -> Column:
    return F.when(last.isin("unavailable", "superseded"), last).when(last.isNotNull() & gone, "reappeared").otherwise("active")


def known_types(active: Sequence[str] = tuple(ACTIVE)) -> list[str]:
    return [*active, "unavailable", "superseded"]


def entity_state(log: DataFrame, keys: Sequence[str] = ("company_id", "entity_id"), pos: str = "ingest_seq") -> DataFrame:
    """(keys, first_seen_at, last_seen_at, status)."""
    known = F.col("event_type").isin(known_types())
    last = F.max(F.when(known, F.struct("event_time", "event_id", pos, "event_type")))
    state = log.groupBy(*keys).agg(F.min("event_time").alias("first_seen_at"), F.max("event_time").alias("last_seen_at"), last.alias("last"), F.max(F.col("event_type") == "unavailable").alias("gone"))
    return state.select(*keys, "first_seen_at", "last_seen_at", _status(F.col("last.event_type"), F.coalesce("gone", F.lit(False))).alias("status"))


def state_history(log: DataFrame, keys: Sequence[str] = ("company_id", "entity_id"), pos: str = "ingest_seq") -> DataFrame:
    """The status after each event."""
    upto = Window.partitionBy(*keys).orderBy("event_time", "event_id", pos).rowsBetween(Window.unboundedPreceding, 0)
    known = F.when(F.col("event_type").isin(known_types()), F.col("event_type"))
    gone = F.coalesce(F.max(F.col("event_type") == "unavailable").over(upto), F.lit(False))
    return log.select(*keys, "event_id", pos, _status(F.last(known, ignorenulls=True).over(upto), gone).alias("status"))


def latest_payload(log: DataFrame, keys: Sequence[str] = ("company_id", "entity_id"), pos: str = "ingest_seq") -> DataFrame:
    """(keys, key, value): each payload key's newest value; an explicit null overrides, an absent key does not."""
    pairs = log.select(*keys, "event_time", "event_id", pos, F.explode(F.from_json("payload", "map<string,string>")).alias("key", "value"))
    return pairs.groupBy(*keys, "key").agg(F.max_by(F.struct("value"), order(pos)).alias("v")).select(*keys, "key", F.col("v.value").alias("value"))


def manifest_counts(state: DataFrame) -> DataFrame:
    """Counts of sources, active ones (reappeared included) and unavailable ones, per company."""
    return state.groupBy("company_id").agg(F.count("*").alias("sources_total"), F.count_if(F.col("status").isin("active", "reappeared")).alias("sources_active"), F.count_if(F.col("status") == "unavailable").alias("sources_unavailable"))


def next_event_id(log: DataFrame) -> DataFrame:
    """The next ``evt_`` id of the log; other forms of ids do not count."""
    number = F.max(F.regexp_extract("event_id", r"^evt_(\d+)$", 1).try_cast("long"))
    return log.agg(F.format_string("evt_%06d", F.coalesce(number, F.lit(0)) + 1).alias("next_id"))
