"""The event-log state as a stream: order-insensitive aggregates, so late events need no watermark."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.operators.eventlog import entity_state
from ledgerloom.session import own_path, stream_of
from ledgerloom.streaming.changefeed import BATCH_BYTES, STATE_CONF, _settings

KEY = ("company_id", "entity_id")


def streamed_state(spark: SparkSession, path: str) -> DataFrame:
    """State of all entities after the feed files at ``path``.

    Each batch writes the entities it touched into a folder of its own, overwritten if the batch is run again; the newest
    version of an entity counts.
    """
    columns = ["company_id", "entity_id", "event_time", "event_id", "event_type", "ingest_seq"]
    folder = own_path(spark, "state")
    state = entity_state(stream_of(spark, path, columns, BATCH_BYTES))

    def write(batch: DataFrame, version: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/out/version={version}")

    with _settings(spark, STATE_CONF):
        state.writeStream.outputMode("update").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).foreachBatch(write).start().awaitTermination()
    rest = [c for c in state.columns if c not in KEY]
    shape = spark.createDataFrame([], state.schema).withColumn("version", F.lit(0).cast("int")).schema
    try:
        versions = spark.read.schema(shape).parquet(f"{folder}/out")
    except AnalysisException:  # an empty feed wrote nothing
        return spark.createDataFrame([], state.schema)
    return versions.groupBy(*KEY).agg(F.max_by(F.struct(*rest), "version").alias("s")).select(*KEY, "s.*")
