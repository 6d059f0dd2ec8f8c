"""Scans of event logs and structured artifacts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVENT = "event_id string, event_time string, run_id string, entity_type string, entity_id string, event_type string, payload string"


def exists(spark: SparkSession, path: str) -> bool:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(hadoop)
    return bool(found) and len(found) > 0


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """Events of a JSONL log with their place (``pos``: file, block and line order); a missing log is empty.

    Blank lines are skipped; a malformed line raises.
    """
    if not exists(spark, path):
        return spark.createDataFrame([], EVENT + ", pos long")
    lines = spark.read.text(path).filter("trim(value) <> ''")
    doc = F.from_json("value", "event_id string, event_time string, run_id string, entity_type string, entity_id string, event_type string, payload string", {"mode": "FAILFAST"})
    return lines.select(doc.alias("e"), F.monotonically_increasing_id().alias("pos")).select("e.*", "pos")


def read_artifacts(spark: SparkSession, path: str) -> DataFrame:
    """(file_name, raw, kind) of the artifact files of a folder: the inventory and files that start with ``_`` are none."""
    if not exists(spark, path):
        return spark.createDataFrame([], "file_name string, raw string, kind string")
    files = spark.read.option("pathGlobFilter", "*.json").text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file_name"), F.col("value").alias("raw"))
    kept = files.filter((F.col("file_name") != "source_inventory.json") & ~F.col("file_name").startswith("_"))
    return kept.withColumn("kind", artifact_kind("raw"))


def artifact_kind(raw: str):
    """financial before product before extracted, by the keys that are there, even with null values."""
    keys = F.json_object_keys(raw)
    has = lambda *names: F.coalesce(F.forall(F.array(*[F.lit(n) for n in names]), lambda n: F.array_contains(keys, n)), F.lit(False))
    return F.when(has("line_items", "periods"), "financial").when(has("entities"), "product").otherwise("extracted")


def read_raw(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path)


def read_document(spark: SparkSession, path: str, label: str, *, strict: bool = True) -> DataFrame:
    """(raw) of one JSON document; strict: a missing file raises; lenient: missing or no object gives no row."""
    if not exists(spark, path):
        if strict:
            raise FileNotFoundError(f"{label} not found: {path}")
        return spark.createDataFrame([], "raw string")
    docs = spark.read.text(path, wholetext=True).select(F.col("value").alias("raw"))
    return docs if strict else docs.filter(F.json_object_keys("raw").isNotNull())
