"""Comparison of two runs of each company, and the change log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def compare_inventories(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, source_id, change_kind, diff_class) of two inventories with the same ``keys``.

    A source that is unavailable afterwards is ``unavailable`` and also ``added`` if it is new; it is never ``changed``.
    A changed source has the class its row states, else content_change.
    """
    both = [*keys, "source_id"]
    old = before.groupBy(*both).agg(F.max_by(F.struct("content_hash"), F.struct("ingested_at", "content_hash")).alias("old"))
    new = after.groupBy(*both).agg(F.max_by(F.struct("content_hash", "retrieval_status", "diff_class"), F.struct("ingested_at", "content_hash", "retrieval_status", "diff_class")).alias("new"))
    joined = old.join(new, both, "full_outer")
    gone = F.coalesce(F.col("new.retrieval_status") == "unavailable", F.lit(False))
    differs = F.col("old").isNotNull() & F.col("new").isNotNull() & ~gone & ~F.col("old.content_hash").eqNullSafe(F.col("new.content_hash"))
    kinds = F.array(F.when(F.col("old").isNull(), "added"), F.when(F.col("new").isNull(), "removed"), F.when(gone, "unavailable"), F.when(differs, "changed"))
    rows = joined.withColumn("change_kind", F.explode(F.array_compact(kinds)))
    given = F.when(F.col("change_kind") == "changed", F.coalesce(F.nullif("new.diff_class", F.lit("")), F.lit("content_change")))
    return rows.select(*both, "change_kind", given.alias("diff_class"))


def consecutive_changes(inventory: DataFrame) -> DataFrame:
    """The comparison of each pair of neighbouring runs of a company: (company_id, to_run, source_id, change_kind, diff_class).

    Runs are numbered once; a source's state of one run meets its state of the next by (company, source, number), so no join has
    the company alone as its key.
    """
    runs = inventory.select("company_id", "run_id").dropna().distinct()
    by = Window.partitionBy("company_id").orderBy("run_id")
    calendar = runs.select("company_id", "run_id", F.row_number().over(by).alias("no"), F.lead("run_id").over(by).alias("next_run"))
    rows = inventory.join(calendar, ["company_id", "run_id"])
    keys = ["company_id", "to_run"]
    before = rows.filter("next_run is not null").withColumn("to_run", F.col("next_run"))
    return compare_inventories(before, rows.filter("no > 1").withColumn("to_run", F.col("run_id")), keys)


def delta_type(pairs: DataFrame) -> DataFrame:
    """``pairs`` (``from_repro`` and ``to_repro``, maps of a run's reproducibility) with delta_type: schema before extraction before source.

    A key that is missing and a key that is null are told apart.
    """

    def differs(field: str) -> Column:
        at = lambda m: F.when(F.coalesce(F.map_contains_key(m, F.lit(field)), F.lit(False)), F.coalesce(F.try_element_at(m, F.lit(field)), F.lit("None"))).otherwise("")
        return at(F.col("from_repro")) != at(F.col("to_repro"))

    return pairs.withColumn("delta_type", F.when(differs("schema_set_hash"), "schema_delta").when(differs("prompt_set_hash") | differs("model_id"), "extraction_delta").otherwise("source_delta"))


def change_log(changes: DataFrame, *, from_run: str, to_run: str, delta: str, generated: str) -> str:
    """Markdown of one comparison; the caller passes the changes of one pair of runs."""
    rows = [(r.change_kind, r.source_id, r.diff_class) for r in changes.orderBy("source_id").toLocalIterator()]
    kinds = [("added", "New"), ("changed", "Changed"), ("unavailable", "Unavailable"), ("removed", "Removed")]
    counts = ", ".join(f"{sum(k == kind for k, _, _ in rows)} {kind}" for kind, _ in kinds)
    out = ["# Change Log", "", f"Generated: {generated}", f"From run:  {from_run}", f"To run:    {to_run}", f"Delta type: {delta}", f"Counts: {counts}", ""]
    for kind, title in kinds:
        lines = [f"- `{s}` — {d}" if kind == "changed" else f"- {s}" for k, s, d in rows if k == kind]
        out += [f"## {title} sources", "", *(lines or ["_None_"]), ""]
    return "\n".join(out)
