"""Registered queries of the training-data operators of the core, with the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.operators import orphans, shredding, snapshots, units
from ledgerloom.session import materialise, table
from ledgerloom.streaming import changefeed


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return orphans.corpus_orphans(*[table(spark, folder, t) for t in ("financial_artifact", "source_inventory", "artifact_registry")])


def p1_by_month(spark: SparkSession, folder: str) -> DataFrame:
    """Report: orphans per table, month and kind."""
    return p1_found(spark, folder).groupBy("ref_table", "run_month", "orphan_kind").agg(F.count("*").alias("n_orphans"))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return snapshots.change_events(table(spark, folder, "source_inventory"))


def p2_intervals(spark: SparkSession, folder: str) -> DataFrame:
    """The validity intervals behind p2_found."""
    return snapshots.validity_intervals(table(spark, folder, "source_inventory")).select("company_id", "source_id", "first_run", "last_run")


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return changefeed.apply_change_feed(spark, f"{folder}/example_source_registry.parquet")


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    items = shredding.financial_tables(table(spark, folder, "financial_artifact"))["line_items"]
    linked = items.filter("normalized_candidate__taxonomy_key is not null and period_pos is not null")
    return linked.select("artifact_id", F.col("pos").alias("line_pos"), "period_pos").distinct()


def p4_periods(spark: SparkSession, folder: str) -> DataFrame:
    """The flat table of periods."""
    periods = shredding.financial_tables(table(spark, folder, "financial_artifact"))["periods"].filter("not is_null")
    return periods.select("artifact_id", F.col("pos").alias("period_pos"), "period_id", "currency_reported", "unit_scale", "fiscal_year").distinct()


def _dollars(spark: SparkSession, folder: str) -> DataFrame:
    return units.in_dollars(units.stated_values(table(spark, folder, "financial_artifact")), table(spark, folder, "fx_rate"))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return units.agreeing_pairs(_dollars(spark, folder))


def p5_units(spark: SparkSession, folder: str) -> DataFrame:
    """Every value with the unit it was read in, its dollars, whether the unit is unique and whether other figures contradict it."""
    values = units.check_units(materialise(_dollars(spark, folder), "dollars"))
    return values.select("artifact_id", "line_pos", "period_id", "taxonomy_key", "currency", "scale", "usd", "unit_status", "residual", "contradicted")


P1_SQL = """
with inv as (select distinct company_id, run_id, source_id from source_inventory),
span as (select company_id, source_id, min(run_id) lo, max(run_id) hi from inv group by all),
cite as (select distinct artifact_id, company_id, run_id, source_id from financial_artifact where trim(source_id) <> ''),
a as (
  select 'financial_artifact' ref_table, c.artifact_id record_id, c.run_id,
    case when s.lo < c.run_id then 'deleted' when s.hi > c.run_id then 'late' else 'missing' end orphan_kind
  from cite c left join span s using (company_id, source_id)
  where not exists (select 1 from inv i where i.company_id = c.company_id and i.run_id = c.run_id and i.source_id = c.source_id)),
fa as (select artifact_id, min(run_id) lo from financial_artifact group by all),
gone as (select distinct entity_id from artifact_registry where event_type in ('superseded', 'unavailable')),
b as (
  select 'artifact_registry' ref_table, r.event_id record_id, r.run_id,
    case when f.lo is not null then 'late' when g.entity_id is not null then 'deleted' else 'missing' end orphan_kind
  from artifact_registry r left join fa f on f.artifact_id = r.entity_id left join gone g on g.entity_id = r.entity_id
  where trim(r.entity_id) <> '' and (f.lo is null or f.lo > r.run_id)),
found as (select distinct ref_table, record_id, substr(run_id, 1, 4) || '-' || substr(run_id, 5, 2) run_month, orphan_kind
  from (select * from a union all select * from b))
"""

P2_SQL = """
with clean as (select company_id, run_id, source_id, ingested_at, retrieval_status s,
    nullif(regexp_replace(regexp_replace(lower(content_hash), '\\s+', '', 'g'), '^sha-?256[:=]?', ''), '') h from source_inventory),
best as (select company_id, run_id, source_id, arg_max({'s': s, 'h': h}, ingested_at) v from clean group by all),
runs as (select company_id, run_id, row_number() over (partition by company_id order by run_id) n,
    lead(run_id) over (partition by company_id order by run_id) nxt from (select distinct company_id, run_id from source_inventory)),
x as (select b.*, r.n, r.nxt from best b join runs r using (company_id, run_id)),
pair as (select coalesce(b.company_id, a.company_id) company_id, coalesce(b.run_id, a.nxt) run_id, coalesce(b.source_id, a.source_id) source_id,
    a.v av, b.v bv, a.n an, b.n bn, a.nxt
  from x a full join x b on a.company_id = b.company_id and a.source_id = b.source_id and a.n + 1 = b.n)
select company_id, run_id, source_id,
  case when an is null then 'added' when bn is null then 'removed' else 'changed' end change_kind
from pair
where (an is null and bn > 1) or (bn is null and nxt is not null)
  or (an is not null and bn is not null and (av.s is distinct from bv.s or (av.s = 'ok' and bv.s = 'ok' and av.h <> bv.h)))
"""

P2_SPANS_SQL = P2_SQL[: P2_SQL.index("pair as")] + """y as (select company_id, source_id, run_id, n, v, lag(n) over w pn, lag(v) over w pv from x window w as (partition by company_id, source_id order by n)),
z as (select *, sum(case when pn is null or n > pn + 1 or v.s is distinct from pv.s or (v.s = 'ok' and pv.s = 'ok' and v.h <> pv.h) then 1 else 0 end)
  over (partition by company_id, source_id order by n) island from y)
select company_id, source_id, min(run_id) first_run, max(run_id) last_run from z group by company_id, source_id, island
"""

P3_SQL = """
with d as (select event_id, arg_max({'t': event_time, 'e': entity_id, 'k': event_type}, ingest_seq) v from example_source_registry group by all),
ok as (select event_id, v.e entity_id, v.k k, try_cast(case when regexp_matches(v.t, '(Z|[+-]\\d\\d:\\d\\d)$') then v.t else v.t || 'Z' end as timestamptz) ts from d
  where v.k in ('discovered', 'retrieved', 'canonicalized', 'validated', 'unavailable', 'superseded')),
last as (select entity_id, arg_max({'id': event_id, 'k': k}, {'ts': ts, 'id': event_id}) v from ok where ts is not null group by all)
select entity_id, v.id event_id from last where v.k not in ('unavailable', 'superseded')
"""

P4_SQL = """
with li as (select artifact_id, line_items, periods, unnest(range(len(line_items))) i from financial_artifact),
one as (select artifact_id, i, line_items[i + 1] l, periods from li),
hit as (select artifact_id, i, list_max(list_filter(range(len(periods)), lambda j: periods[j + 1].period_id = l.column_ref)) j
  from one where l.normalized_candidate.taxonomy_key is not null)
select distinct artifact_id, cast(i as int) line_pos, cast(j as int) period_pos from hit where j is not null
"""

P4_PERIODS_SQL = """
with p as (select artifact_id, periods, unnest(range(len(periods))) j from financial_artifact), q as (select artifact_id, j, periods[j + 1] e from p)
select distinct artifact_id, cast(j as int) period_pos, e.period_id, e.currency_reported, e.unit_scale, e.fiscal_year from q where e is not null
"""

QUERIES = {f.__name__: f for f in (p1_found, p1_by_month, p2_found, p2_intervals, p3_found, p4_found, p4_periods, p5_found, p5_units)}
SQL = {
    "p1_found": P1_SQL + "select * from found",
    "p1_by_month": P1_SQL + "select ref_table, run_month, orphan_kind, count(*) n_orphans from found group by all",
    "p2_found": P2_SQL,
    "p2_intervals": P2_SPANS_SQL,
    "p3_found": P3_SQL,
    "p4_found": P4_SQL,
    "p4_periods": P4_PERIODS_SQL,
}
