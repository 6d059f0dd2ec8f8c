"""Applying a feed of inserts, updates and deletes that repeats itself and arrives out of order.

Stage one is a stream.  Keyed state holds for each event id the last sequence number, the payload of that delivery
and, in it, whether the delivery voids the event (a tombstone: unreadable time or unknown type).  A delivery replaces
the state only if its sequence is higher, so replays and late arrivals change nothing.  Each micro-batch emits the
touched keys as upserts into a folder named by the batch (``version=<batch id>``, overwritten if the batch is run
again): output is idempotent.

Stage two folds the newest version of each event into its entity with ``max_by``, a map-side combinable aggregate, so
an entity that owns a third of all events is no hot task.
"""

from __future__ import annotations

from collections.abc import Sequence
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.session import own_path, stream_of

LIVE_TYPES = ("discovered", "retrieved", "canonicalized", "validated")
GONE_TYPES = ("unavailable", "superseded")

STATE_CONF = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "256",
    "spark.sql.streaming.minBatchesToRetain": "2",
}
#: Bytes of feed files that one micro-batch takes at most.
BATCH_BYTES = 16 << 30


@contextmanager
def _settings(spark: SparkSession, conf: dict[str, str]):
    before = {k: spark.conf.get(k, None) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def instant(column: str) -> Column:
    """Microseconds since the epoch of an ISO time; a time without a zone is UTC; null where it can't be read."""
    text = F.trim(F.col(column))
    shape = r"^\d{4}-\d{2}-\d{2}[Tt ]\d{2}:\d{2}(:\d{2}([.,]\d{1,9})?)?\s*([Zz]|[+-]\d{2}(:?\d{2})?)?$"
    zoned = F.when(text.rlike(r"([Zz]|[+-]\d{2}(:?\d{2})?)$") & text.rlike(r":\d{2}.*([Zz]|[+-]\d{2}(:?\d{2})?)$"), F.upper(text)).otherwise(F.concat(text, F.lit("Z")))
    zoned = F.regexp_replace(F.regexp_replace(F.regexp_replace(zoned, ",", "."), r"\s+(?=[Z+-])", ""), r"([+-]\d{2})(\d{2})$", "$1:$2")
    return F.when(text.rlike(shape), F.unix_micros(zoned.try_cast("timestamp")))


def deliveries(feed: DataFrame) -> DataFrame:
    """(event_id, seq, payload) of a source feed; ``payload.at`` is null for an event that changes nothing."""
    known = F.col("event_type").isin(*LIVE_TYPES, *GONE_TYPES)
    payload = F.struct(F.when(known, instant("event_time")).alias("at"), "entity_id", "event_type")
    return feed.select("event_id", F.col("ingest_seq").alias("seq"), payload.alias("payload"))


def stream_upserts(feed: DataFrame, folder: str) -> list[int]:
    """Run the keyed stream over what the feed holds now; returns the versions written below ``folder/upserts``.

    ``feed``: a streaming frame (event_id, seq, payload).  Started again on the same folder it goes on where it
    stopped.  Deliveries without key or sequence are no changes.
    """
    spark, versions = feed.sparkSession, []
    order = F.struct("seq", "payload")
    state = feed.filter("event_id is not null and seq is not null").groupBy("event_id").agg(F.max(order).alias("last"))

    def write(batch: DataFrame, version: int) -> None:
        batch.select("event_id", "last.seq", "last.payload").write.mode("overwrite").parquet(f"{folder}/upserts/version={version}")
        versions.append(version)

    with _settings(spark, STATE_CONF):
        query = state.writeStream.outputMode("update").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).foreachBatch(write).start()
        query.awaitTermination()
    return versions


def newest(upserts: DataFrame) -> DataFrame:
    """The newest delivery of each event over all versions."""
    return upserts.groupBy("event_id").agg(F.max(F.struct("seq", "payload")).alias("last")).select("event_id", "last.payload")


def current_entities(events: DataFrame) -> DataFrame:
    """Entities that exist after all changes, each with the event that decided it: (entity_id, event_id).

    The last event by instant, then by id, decides; no entity comes out whose deciding event is a removal.
    Events with a null instant or entity change nothing.
    """
    valid = events.select("event_id", "payload.*").filter("at is not null and entity_id is not null")
    last = valid.groupBy("entity_id").agg(F.max(F.struct("at", "event_id", "event_type")).alias("last"))
    return last.filter(~F.col("last.event_type").isin(*GONE_TYPES)).select("entity_id", "last.event_id")


def apply_change_feed(spark: SparkSession, path: str, columns: Sequence[str] = ("event_id", "event_time", "entity_id", "event_type", "ingest_seq")) -> DataFrame:
    """The current entities of the feed files at ``path``; an empty feed gives no entities."""
    schema = spark.read.parquet(path).select(*columns).schema
    folder = own_path(spark, "feed")
    feed = stream_of(spark, path, list(columns), BATCH_BYTES)
    versions = stream_upserts(deliveries(feed), folder)
    fields = deliveries(spark.createDataFrame([], schema)).schema
    if not versions:
        return current_entities(newest(spark.createDataFrame([], fields)))
    return current_entities(newest(spark.read.schema(fields).parquet(f"{folder}/upserts")))
