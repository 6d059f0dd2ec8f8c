"""What changed between full snapshots: gaps and islands over key and row state.

Each (scope, key) has at most one row a run.  Rows of consecutive runs with an unchanged state form an island, a
validity interval.  An interval that starts after the scope's first run is an ``added`` event, or ``changed`` if the
key's previous interval ends in the run before; an interval that ends before the scope's last run with no adjacent
successor is a ``removed`` event in the run after.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Copies of the run calendar; the rows of one run of one company are spread over so many join keys.
RUN_SALT = 16


def hash_form(column: str) -> Column:
    """A content hash in one spelling (bytes): case, blanks and an algorithm prefix do not count; blank is null."""
    bare = F.regexp_replace(F.regexp_replace(F.lower(F.col(column)), r"\s+", ""), r"^sha-?256[:=]?", "")
    even = F.when(F.length(bare) % 2 == 0, F.unhex(bare))
    return F.when(F.length(bare) > 0, F.coalesce(F.when(bare.rlike("^[0-9a-f]+$"), even), F.encode(bare, "UTF-8")))


def run_calendar(snapshots: DataFrame) -> DataFrame:
    """The runs of each company with their number from 1, the next run and the count of runs."""
    runs = snapshots.select("company_id", "run_id").dropna().distinct()
    by_company = Window.partitionBy("company_id").orderBy("run_id")
    return runs.select("company_id", "run_id", F.row_number().over(by_company).alias("run_no"), F.lead("run_id").over(by_company).alias("next_run"))


def snapshot_states(snapshots: DataFrame) -> DataFrame:
    """One row per (company, run, source): the one with the latest ``ingested_at``.

    Equal times are settled by the larger (status, hash), so that the result does not depend on the order of rows.
    A null ``ingested_at`` is older than any.  Rows without company, run or source are no snapshot rows.
    """
    keyed = snapshots.select("company_id", "run_id", "source_id", "ingested_at", F.struct(F.col("retrieval_status").alias("status"), hash_form("content_hash").alias("hash")).alias("state"))
    keyed = keyed.dropna(subset=["company_id", "run_id", "source_id"])
    order = F.struct(F.col("ingested_at").isNotNull(), "ingested_at", "state")
    return keyed.groupBy("company_id", "run_id", "source_id").agg(F.max_by("state", order).alias("state"))


def state_changed(before: str, after: str) -> Column:
    """Whether two neighbouring states differ: another status, or two different hashes that are both there and ok."""
    b, a = F.col(before), F.col(after)
    both_ok = (b["status"] == "ok") & (a["status"] == "ok")
    return ~b["status"].eqNullSafe(a["status"]) | F.coalesce(both_ok & (b["hash"] != a["hash"]), F.lit(False))


def validity_intervals(snapshots: DataFrame) -> DataFrame:
    """Validity intervals (company_id, source_id, first_no, last_no, first_run, last_run, after_run)."""
    states = snapshot_states(snapshots).withColumn("salt", F.pmod(F.xxhash64("source_id"), F.lit(RUN_SALT)).cast("int"))
    calendar = run_calendar(snapshots).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(RUN_SALT - 1))))
    rows = states.join(calendar, ["company_id", "run_id", "salt"])
    by_key = Window.partitionBy("company_id", "source_id").orderBy("run_no")
    rows = rows.withColumns({"prev_no": F.lag("run_no").over(by_key), "prev_state": F.lag("state").over(by_key)})
    starts = F.col("prev_no").isNull() | (F.col("run_no") > F.col("prev_no") + 1) | state_changed("prev_state", "state")
    rows = rows.withColumn("island", F.sum(starts.cast("int")).over(by_key.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy("company_id", "source_id", "island").agg(
        F.min("run_no").alias("first_no"),
        F.max("run_no").alias("last_no"),
        F.min("run_id").alias("first_run"),
        F.max("run_id").alias("last_run"),
        F.max_by("next_run", "run_no").alias("after_run"),
    )


def change_events(snapshots: DataFrame) -> DataFrame:
    """Change events (company_id, run_id, source_id, change_kind) of consecutive runs; a first run yields nothing.

    Empty input gives no events; repeated rows count once; other columns are ignored.
    """
    by_key = Window.partitionBy("company_id", "source_id").orderBy("island")
    spans = validity_intervals(snapshots).withColumns({"before_no": F.lag("last_no").over(by_key), "after_no": F.lead("first_no").over(by_key)})
    began = F.when(F.col("first_no") > 1, F.struct(F.col("first_run").alias("run_id"), F.when(F.col("before_no") == F.col("first_no") - 1, "changed").otherwise("added").alias("change_kind")))
    lasts = F.col("after_no") == F.col("last_no") + 1
    ended = F.when(F.col("after_run").isNotNull() & ~F.coalesce(lasts, F.lit(False)), F.struct(F.col("after_run").alias("run_id"), F.lit("removed").alias("change_kind")))
    events = spans.select("company_id", "source_id", F.explode(F.array(began, ended)).alias("e")).filter("e is not null")
    return events.select("company_id", "e.run_id", "source_id", "e.change_kind")
