"""Session helpers: table access and lineage cuts that survive the loss of an executor."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The setting by which a cluster names its shared folder.
CHECKPOINT_KEY = "spark.checkpoint.dir"


def local_session(cores: str = "8", **conf: str) -> SparkSession:
    """A session for tests and the bench; on a cluster the session comes from outside."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName("ledgerloom")
    base = {
        "spark.sql.shuffle.partitions": "8",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "8g",
        "spark.sql.adaptive.enabled": "true",
    }
    for key, value in (base | conf).items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


_fallback: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The shared folder named in ``spark.checkpoint.dir``; a temporary one only where it is unset and all runs in one process, as in tests.

    A cluster without the setting raises: a folder of one machine would lose rows.
    """
    folder = spark.conf.get(CHECKPOINT_KEY, None) or spark.sparkContext.getConf().get(CHECKPOINT_KEY)
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError(f"{CHECKPOINT_KEY} must name a folder that all executors share")
        app = spark.sparkContext.applicationId
        folder = _fallback.setdefault(app, f"file://{tempfile.mkdtemp(prefix='ledgerloom-')}") if app not in _fallback else _fallback[app]
    return folder.rstrip("/")


def own_path(spark: SparkSession, tag: str) -> str:
    """A new path in the shared folder; it is removed when this program ends, if its session still lives."""
    path = f"{shared_dir(spark)}/ledgerloom/{tag}-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, path)
    return path


def _remove(spark: SparkSession, path: str) -> None:
    try:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
    except Exception:  # the session may be gone; a file that stays is no error
        pass


def materialise(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: a lineage cut that any executor can re-read."""
    spark = df.sparkSession
    path = own_path(spark, tag)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def stream_of(spark: SparkSession, path: str, columns: list[str], batch_bytes: int) -> DataFrame:
    """A stream over the parquet table at ``path``, a file or a folder of files."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    schema = spark.read.parquet(path).select(*columns).schema
    reader = spark.readStream.schema(schema).option("maxBytesPerTrigger", str(batch_bytes))
    if place.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(place).isDirectory():
        return reader.parquet(path)
    name = re.sub(r"([\[\]{}*?\\])", r"\\\1", place.getName())
    return reader.option("pathGlobFilter", name).parquet(place.getParent().toString())


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The parquet table ``name`` of a data folder (a file or a directory of files)."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def filled(column: str):
    """True where a text column holds something other than blanks."""
    return F.length(F.trim(F.col(column))) > 0
