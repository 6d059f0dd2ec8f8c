"""Gates and reporters over the artifacts of every run; each is one plan over all runs at once.

A gate gives rows (company_id, run_id, artifact_id, problem); ``gate_report`` turns them into one row per run and gate.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.dates import older_than, parse_iso
from ledgerloom.operators.eventlog import entity_state
from ledgerloom.operators.merge import financial_observations, merge_financials, merge_products, product_observations
from ledgerloom.operators.shredding import financial_tables

RUN = ("company_id", "run_id")
GATES = ["schemas_valid", "referential_integrity", "lineage_complete", "id_integrity", "financial_usability", "manifest_closure", "refresh_semantics", "conflict_visibility"]
#: Gates that show what they find and always pass.
VISIBLE = ["conflict_visibility"]


def _blank(c: Column) -> Column:
    return c.isNull() | (c == "")


def lineage_ok(lineage: Column) -> Column:
    """Three filled texts, a locator with entries, and a prompt (whose values may be null)."""
    texts = ["source_snapshot_id", "content_path", "snippet"]
    filled = reduce(lambda a, b: a & b, [~_blank(lineage[t]) for t in texts])
    return F.coalesce(filled & (F.size(lineage["locator"]) > 0) & lineage["extraction_prompt"].isNotNull(), F.lit(False))


def referenced_sources(artifacts: DataFrame) -> DataFrame:
    """(company_id, run_id, artifact_id, source_id) of the filled references, each once."""
    return artifacts.filter(~_blank(F.col("source_id"))).select(*RUN, "artifact_id", "source_id").distinct()


def referential_integrity(artifacts: DataFrame, inventory: DataFrame, dossiers: DataFrame | None = None) -> DataFrame:
    """Artifacts whose filled source id is not in the inventory of their run, and citations of dossiers that name no artifact of theirs."""
    known = inventory.select(*RUN, "source_id").distinct()
    missing = referenced_sources(artifacts).join(known, [*RUN, "source_id"], "left_anti")
    out = missing.select(*RUN, "artifact_id", F.concat(F.lit("source_id "), "source_id", F.lit(" not in inventory")).alias("problem"))
    return out if dossiers is None else out.unionByName(dossier_references(dossiers, artifacts))


def dossier_references(dossiers: DataFrame, artifacts: DataFrame) -> DataFrame:
    """Citations of dossier claims (sections array of claims array) that name no artifact of the run."""
    cited = dossiers.select(*RUN, F.explode("sections").alias("s")).select(*RUN, F.explode("s.claims").alias("c")).select(*RUN, F.explode("c.citations").alias("artifact_id")).filter("artifact_id is not null").distinct()
    return cited.join(artifacts.select(*RUN, "artifact_id").distinct(), [*RUN, "artifact_id"], "left_anti").withColumn("problem", F.lit("citation not in artifact set"))


def uncited_claims(dossiers: DataFrame) -> DataFrame:
    """Facts and evidence without a citation; the text is cut to 60 characters."""
    claims = dossiers.select(*RUN, F.explode("sections").alias("s")).select(*RUN, F.explode("s.claims").alias("c")).filter("c.kind in ('fact', 'evidence')")
    bare = claims.filter(F.coalesce(F.size("c.citations"), F.lit(0)) <= 0)
    return bare.select(*RUN, F.lit(None).cast("string").alias("artifact_id"), F.concat(F.lit("dossier claim ("), "c.kind", F.lit(") has no citations: "), F.substring("c.text", 1, 60)).alias("problem"))


def lineage_complete(artifacts: DataFrame, dossiers: DataFrame | None = None) -> DataFrame:
    """Artifacts without a complete lineage, and facts and evidence of dossiers without a citation."""
    out = artifacts.filter(~lineage_ok(F.col("lineage"))).select(*RUN, "artifact_id", F.lit("lineage check failed").alias("problem"))
    return out if dossiers is None else out.unionByName(uncited_claims(dossiers))


def id_integrity(artifacts: DataFrame) -> DataFrame:
    """Artifact ids that occur more than once in their run."""
    return artifacts.filter("artifact_id is not null").groupBy(*RUN, "artifact_id").count().filter("count > 1").select(*RUN, "artifact_id", F.lit("duplicate artifact_id").alias("problem"))


def financial_usability(artifacts: DataFrame) -> DataFrame:
    """Problems of line items, found in the row itself: scope, locator, period, currency, scale, repeated items."""
    periods = F.transform("periods", lambda p: F.struct(p["period_id"].alias("period_id"), p["currency_reported"].alias("currency"), p["unit_scale"].alias("scale")))
    # Maps become tables of their own, so whether a locator has entries is noted before shredding.
    fields = artifacts.schema["line_items"].dataType.elementType.names
    located = F.transform("line_items", lambda i: F.when(i.isNotNull(), F.struct(*[i[f].alias(f) for f in fields], (F.coalesce(F.size(i["cell_locator"]), F.lit(0)) > 0).alias("located"))))
    artifacts = artifacts.withColumn("line_items", located)
    marked = artifacts.withColumns({"_doc": F.monotonically_increasing_id(), "_periods": periods})
    items = financial_tables(marked, (*RUN, "artifact_id", "_periods", "_doc"))["line_items"].filter("not is_null")
    period = F.element_at("_periods", F.col("period_pos") + 1)
    has, col = F.col("period_pos").isNotNull() & (F.col("column_ref") != ""), F.col("column_ref").isNotNull()
    checks = [
        (F.col("scope").isNull(), "scope is null"),
        (~F.col("located"), "cell_locator is missing or empty"),
        (col & ~F.coalesce(has, F.lit(False)), "column_ref not in periods"),
        (col & has & _blank(period["currency"]), "period missing currency_reported"),
        (col & has & _blank(period["scale"]), "period missing unit_scale"),
    ]
    said = F.array_compact(F.array(*[F.when(c, F.lit(m)) for c, m in checks]))
    single = items.select(*RUN, "artifact_id", "line_item_id", F.explode(said).alias("problem"))
    twice = items.groupBy("_doc", *RUN, "artifact_id", "scope", "column_ref", "line_item_id").count().filter("count > 1")
    again = twice.select(*RUN, "artifact_id", "line_item_id", F.explode(F.array_repeat(F.lit("duplicate (scope, period, line_item_id)"), (F.col("count") - 1).cast("int"))).alias("problem"))
    return single.unionByName(again)


def refresh_drops(log: DataFrame, inventory: DataFrame, latest: DataFrame) -> DataFrame:
    """Sources that are active in the log but not in the inventory of the company's run named in ``latest``: the runs that refresh
    incrementally (other modes have nothing to compare with and take no row there)."""
    active = entity_state(log).filter("status in ('active', 'reappeared')").select("company_id", F.col("entity_id").alias("source_id"))
    expected = active.join(latest, "company_id")
    return expected.join(inventory.select(*RUN, "source_id").distinct(), [*RUN, "source_id"], "left_anti").select(*RUN, "source_id")


def conflicts(artifacts: DataFrame, products: DataFrame | None = None) -> DataFrame:
    """Figures, and product families, of a run whose observations conflict."""
    out = merge_financials(financial_observations(artifacts)).filter("reason is not null").select(*RUN, "conflict_id", F.col("reason").alias("problem"))
    if products is None:
        return out
    return out.unionByName(merge_products(product_observations(products)).filter("conflict_id is not null").select(*RUN, "conflict_id", F.lit("source_authority_conflict").alias("problem")))


def missing_paths(manifest_paths: DataFrame, present: DataFrame) -> DataFrame:
    """Paths that a run manifest names but that are not among the files ``present`` (company_id, run_id, path); a run without paths has none."""
    gone = manifest_paths.filter("path is not null").select(*RUN, "path").distinct().join(present.select(*RUN, "path").distinct(), [*RUN, "path"], "left_anti")
    return gone.withColumn("problem", F.concat(F.lit("missing path: "), "path"))


def stale_sources(inventory: DataFrame, now: str, days: int = 180) -> DataFrame:
    """Sources last seen more than ``days`` days before ``now``; unreadable times do not count; no zone means UTC."""
    return inventory.filter(older_than(F.col("last_seen_at"), parse_iso(F.lit(now)), days)).select(*RUN, "source_id", "last_seen_at").distinct()


def low_confidence(items: DataFrame, threshold: float = 0.5) -> DataFrame:
    return items.filter((F.col("confidence") < threshold) & F.col("artifact_id").isNotNull())


def missing_classes(inventory: DataFrame, expected: list[str]) -> DataFrame:
    """Expected source classes that a run has no primary source of."""
    spark = inventory.sparkSession
    wish = inventory.select(*RUN).distinct().crossJoin(F.broadcast(spark.createDataFrame([(c,) for c in sorted(set(expected))], "source_class string")))  # a short constant list
    have = inventory.filter("source_priority = 'primary'").select(*RUN, "source_class").distinct()
    return wish.join(have, [*RUN, "source_class"], "left_anti")


def gate_report(runs: DataFrame, problems: dict[str, DataFrame]) -> DataFrame:
    """(company_id, run_id, gate, ordinal, passed, n_problems), one row per run and gate of ``problems`` in the fixed order of gates."""
    named = [d.groupBy(*RUN).agg(F.count("*").alias("n")).withColumn("gate", F.lit(g)) for g, d in problems.items()]
    found = reduce(DataFrame.unionByName, named)
    gates = [g for g in GATES if g in problems]
    wide = runs.select(*RUN).distinct().select(*RUN, F.posexplode(F.array(*[F.lit(g) for g in gates])).alias("ordinal", "gate"))
    out = wide.join(found, [*RUN, "gate"], "left")
    return out.select(*RUN, "gate", "ordinal", (F.col("n").isNull() | F.col("gate").isin(VISIBLE)).alias("passed"), F.coalesce("n", F.lit(0)).alias("n_problems"))


def runs_passed(report: DataFrame) -> DataFrame:
    """The verdict on each run: all of its gates passed."""
    return report.groupBy(*RUN).agg(F.every("passed").alias("passed"))
