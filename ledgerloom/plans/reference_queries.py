"""Registered queries of the corpus operators, each with the SQL that checks it.  All run over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.functions import ids, names, pystr, text
from ledgerloom.operators import diff, eventlog, inventory, merge, quality, screening, validate
from ledgerloom.session import table
from ledgerloom.sources import connectors, indicators
from ledgerloom.streaming import state as state_stream

NOW = "2026-06-01T00:00:00"
QUERIES, SQL = {}, {}


def registered(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _log(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "example_source_registry")


STATE_SQL = """
with e as (select company_id, entity_id, event_time, event_id, ingest_seq, event_type from example_source_registry),
s as (select company_id, entity_id, min(event_time) first_seen_at, max(event_time) last_seen_at,
    arg_max(event_type, {'t': event_time, 'i': event_id, 'p': ingest_seq}) filter (event_type in ('discovered', 'retrieved', 'canonicalized', 'validated', 'extracted', 'unavailable', 'superseded')) l,
    bool_or(event_type = 'unavailable') gone from e group by all),
state as (select company_id, entity_id, first_seen_at, last_seen_at,
    case when l in ('unavailable', 'superseded') then l when l is not null and gone then 'reappeared' else 'active' end status from s)
"""


@registered(STATE_SQL + "select * from state")
def event_log_state(spark: SparkSession, folder: str) -> DataFrame:
    return eventlog.entity_state(_log(spark, folder))


@registered("""
with w as (select company_id, entity_id, event_id, ingest_seq,
  last_value(case when event_type in ('discovered', 'retrieved', 'canonicalized', 'validated', 'extracted', 'unavailable', 'superseded') then event_type end ignore nulls) over o l,
  coalesce(bool_or(event_type = 'unavailable') over o, false) gone
  from example_source_registry window o as (partition by company_id, entity_id order by event_time, event_id, ingest_seq rows between unbounded preceding and current row))
select company_id, entity_id, event_id, ingest_seq,
  case when l in ('unavailable', 'superseded') then l when l is not null and gone then 'reappeared' else 'active' end status from w
""")
def state_history(spark: SparkSession, folder: str) -> DataFrame:
    return eventlog.state_history(_log(spark, folder))


@registered("""
with p as (select company_id, entity_id, event_time, event_id, ingest_seq, payload, unnest(json_keys(payload)) k from example_source_registry)
select company_id, entity_id, k as key, arg_max({'v': json_extract_string(payload, '$."' || k || '"')}, {'t': event_time, 'i': event_id, 'p': ingest_seq}).v as value from p group by all
""")
def payload_latest(spark: SparkSession, folder: str) -> DataFrame:
    return eventlog.latest_payload(_log(spark, folder))


_FIELD = "arg_max({{'v': json_extract_string(payload, '$.{f}')}}, {{'t': event_time, 'i': event_id, 'p': ingest_seq}}) filter (list_contains(json_keys(payload), '{f}')) {f}"
INVENTORY_SQL = STATE_SQL + ", r as (select company_id, run_id, entity_id, " + ", ".join(_FIELD.format(f=f) for f in inventory.FIELDS) + """,
  arg_max(event_type, {'t': event_time, 'i': event_id, 'p': -ingest_seq}) latest from example_source_registry group by all),
h as (select company_id, entity_id, max(event_time) filter (event_type in ('retrieved', 'canonicalized')) retrieved_at from example_source_registry group by all)
select r.company_id, r.run_id, r.entity_id source_id, case when url is null then '' else coalesce(url.v, 'None') end url, case when source_class is null then 'unknown' else coalesce(source_class.v, 'None') end source_class,
  case when source_priority.v in ('primary', 'secondary', 'signal') then source_priority.v else 'secondary' end source_priority, nullif(title.v, '') title, nullif(publication_date.v, '') publication_date,
  h.retrieved_at, s.first_seen_at, s.last_seen_at, nullif(content_hash.v, '') content_hash,
  case when latest = 'unavailable' then 'unavailable' when retrieval_status.v in ('ok', 'unavailable', 'error') then retrieval_status.v else 'ok' end retrieval_status,
  case when diff_class.v in ('unchanged', 'cosmetic_change', 'table_change', 'content_change', 'unavailable', 'new') then diff_class.v else 'new' end diff_class, nullif(notes.v, '') notes
from r join h using (company_id, entity_id) join state s using (company_id, entity_id)
"""


@registered(INVENTORY_SQL)
def run_inventories(spark: SparkSession, folder: str) -> DataFrame:
    return inventory.build_inventory(_log(spark, folder))


@registered(STATE_SQL + """select company_id, count(*) sources_total, count(*) filter (status in ('active', 'reappeared')) sources_active,
  count(*) filter (status = 'unavailable') sources_unavailable from state group by all""")
def manifest_counts(spark: SparkSession, folder: str) -> DataFrame:
    return eventlog.manifest_counts(eventlog.entity_state(_log(spark, folder)))


@registered("""select printf('evt_%06d', coalesce(max(try_cast(regexp_extract(event_id, '^evt_([0-9]+)$', 1) as bigint)), 0) + 1) next_id from example_source_registry""")
def next_event_id(spark: SparkSession, folder: str) -> DataFrame:
    return eventlog.next_event_id(_log(spark, folder))


@registered(STATE_SQL + "select * from state")
def event_log_state_stream(spark: SparkSession, folder: str) -> DataFrame:
    """The same state kept by a stream; it must equal event_log_state."""
    return state_stream.streamed_state(spark, f"{folder}/example_source_registry.parquet")


URL_SQL = """
with u as (select distinct url, source_class from source_inventory where url is not null),
a as (select url, source_class, regexp_replace(regexp_replace(trim(url), '[\\t\\r\\n]', '', 'g'), '#.*$', '') t from u),
b as (select url, source_class, lower(regexp_extract(t, '^([A-Za-z][A-Za-z0-9+.-]*):', 1)) s, regexp_replace(t, '^[A-Za-z][A-Za-z0-9+.-]*:', '') r from a),
c as (select *, lower(regexp_extract(r, '^//([^/?]*)', 1)) h, regexp_replace(lower(regexp_extract(r, '^(//[^/?]*)?([^?]*)', 2)), '/+$', '') p,
  list_transform(list_filter(string_split(regexp_extract(r, '\\?(.*)$', 1), '&'), lambda x: x <> ''), lambda x: {'k': url_decode(replace(split_part(x, '=', 1), '+', ' ')), 'v': url_decode(replace(case when contains(x, '=') then regexp_replace(x, '^[^=]*=', '') else '' end, '+', ' '))}) q from b),
d as (select *, case when p = '' then '/' else p end w, list_sort(list_filter(q, lambda x: lower(x.k) not in ('ref', 'fbclid', 'gclid') and not regexp_matches(lower(x.k), '^(utm_|mc_|_ga)'))) l from c),
e as (select url, source_class, case when s = '' then 'https' else s end || ':' || case when h <> '' then '//' || h || case when w[1] = '/' then '' else '/' end || w when w[1] = '/' then '//' || w else w end
  || case when len(l) > 0 then '?' || array_to_string(list_transform(l, lambda x: replace(url_encode(x.k), '%20', '+') || '=' || replace(url_encode(x.v), '%20', '+')), '&') else '' end normal_url from d)
"""


@registered(URL_SQL + "select url, source_class, normal_url, 'src_' || substr(sha256(lower(source_class) || '|' || normal_url), 1, 16) source_id from e")
def source_ids(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "source_inventory").select("url", "source_class").filter("url is not null").distinct()
    return rows.select("url", "source_class", ids.url_normal_form(F.col("url")).alias("normal_url"), ids.source_id(F.col("url"), F.col("source_class")).alias("source_id"))


@registered("""
with n as (select distinct name from registry_record where name is not null),
t as (select name, list_filter(regexp_split_to_array(lower(regexp_replace(strip_accents(name), '[^\\x00-\\x7F]', '', 'g')), '[^a-z0-9]+'), lambda w: length(w) > 1 and w not in
  ('inc','incorporated','corporation','company','co','ltd','limited','llc','llp','plc','sa','ag','gmbh','nv','bv','spa','pty','kk','oyj','ab','as')) w from n)
select name, nullif(array_to_string(w, '-'), '') slug from t
""")
def company_slugs(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "registry_record").select("name").filter("name is not null").distinct()
    return rows.select("name", ids.company_slug(F.col("name")).alias("slug"))


#: Whitespace and the compatibility characters of the tables, for SQL that has no NFKC.
_SQL_BLANKS = r"[\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def _sql_normal(text: str) -> str:
    return f"trim(regexp_replace(nfc_normalize(replace(replace(replace({text}, '…', '...'), 'ﬁ', 'fi'), 'ﬂ', 'fl')), '{_SQL_BLANKS}+', ' ', 'g'))"


CANON_SQL = (
    "with c as (select doc_id, text, "
    + _sql_normal(f"regexp_replace(replace(replace(text, '-' || chr(10), ''), chr(12), chr(10)), '\\n{_SQL_BLANKS}*\\p{{Nd}}+{_SQL_BLANKS}*\\n', chr(10), 'g')")
    + " canon from documents)"
)


@registered(CANON_SQL + "select doc_id, sha256(text) raw_hash, sha256(canon) canonical_hash from c")
def canonical_text_hashes(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    h = text.content_hashes(F.col("text"), F.lit("text/plain"))
    return docs.select("doc_id", h["raw_hash"].alias("raw_hash"), h["canonical_hash"].alias("canonical_hash"))


@registered(CANON_SQL + "select sha256(canon) canonical_hash, count(*) n_documents, min(doc_id) first_doc from c group by 1 having count(*) > 1")
def canonical_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    docs = canonical_text_hashes(spark, folder)
    return docs.groupBy("canonical_hash").agg(F.count("*").alias("n_documents"), F.min("doc_id").alias("first_doc")).filter("n_documents > 1")


#: Hidden elements and comments, an unclosed tag at the end, a bare bracket as a piece of its own, tags, then character references.
_HTML_STEPS = [
    (r"(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>", " "), (r"<[a-zA-Z/!?][^>]*$", ""), (r"<([^a-zA-Z/!?]|$)", r" < \1"), (r"<[a-zA-Z/!?][^>]*>", " "),
    ("&lt;?", "<"), ("&gt;?", ">"), ("&quot;?", '"'), ("&nbsp;?", " "), ("&#39;?", "\'\'"), ("&amp;?", "&"),
]


def _html_sql(text: str) -> str:
    for pattern, by in _HTML_STEPS:
        text = f"regexp_replace({text}, '{pattern}', '{by}', 'g')"
    return text


@registered("select doc_id, sha256(" + _sql_normal(_html_sql("text")) + ") html_hash from documents")
def canonical_html_hashes(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select("doc_id", F.sha2(text.canonical_html(F.col("text")), 256).alias("html_hash"))


@registered(r"""
with v as (select doc_id, text a, case doc_id % 4 when 0 then text when 1 then replace(text, ' ', '  ') when 2 then text || ' appended' end b from documents),
h as (select *, trim(regexp_replace(a, '\s+', ' ', 'g')) ca, trim(regexp_replace(b, '\s+', ' ', 'g')) cb from v)
select case when b is null then 'unavailable' when a = b then 'unchanged' when ca = cb then 'cosmetic_change' else 'content_change' end diff_class, count(*) n from h group by 1
""")
def diff_class_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Every document against a version that is the same, spaced otherwise, extended or gone."""
    kind = F.col("doc_id") % 4
    docs = table(spark, folder, "documents").select("doc_id", F.col("text").alias("a"), F.when(kind == 0, F.col("text")).when(kind == 1, F.replace("text", F.lit(" "), F.lit("  "))).when(kind == 2, F.concat("text", F.lit(" appended"))).alias("b"))

    def hashed(c: str):
        h = text.hash_pair(F.col(c), F.trim(F.regexp_replace(c, r"\s+", " ")), F.lit("text/plain"))
        return F.when(F.col(c).isNotNull(), h)

    rows = docs.select(hashed("a").alias("x"), hashed("b").alias("y"))
    return rows.select(text.diff_class(F.col("x"), F.col("y")).alias("diff_class")).groupBy("diff_class").agg(F.count("*").alias("n"))


@registered("""
with i as (select company_id, run_id, source_id, arg_max({'h': content_hash, 's': retrieval_status, 'd': diff_class}, ingested_at) v from source_inventory group by all),
r as (select company_id, run_id, lead(run_id) over (partition by company_id order by run_id) nxt, lag(run_id) over (partition by company_id order by run_id) prv from (select distinct company_id, run_id from source_inventory)),
o as (select i.company_id, r.nxt to_run, i.source_id, i.v from i join r using (company_id, run_id) where r.nxt is not null),
n as (select i.company_id, i.run_id to_run, i.source_id, i.v from i join r using (company_id, run_id) where r.prv is not null),
j as (select coalesce(o.company_id, n.company_id) company_id, coalesce(o.to_run, n.to_run) to_run, coalesce(o.source_id, n.source_id) source_id, o.source_id os, n.source_id ns, o.v ov, n.v nv
  from o full join n on o.company_id = n.company_id and o.to_run = n.to_run and o.source_id = n.source_id)
select company_id, to_run, source_id, 'added' change_kind, null diff_class from j where os is null
union all select company_id, to_run, source_id, 'removed', null from j where ns is null
union all select company_id, to_run, source_id, 'unavailable', null from j where nv.s = 'unavailable'
union all select company_id, to_run, source_id, 'changed', coalesce(nullif(nv.d, ''), 'content_change') from j where os is not null and ns is not null and nv.s is distinct from 'unavailable' and ov.h is distinct from nv.h
""")
def compare_runs(spark: SparkSession, folder: str) -> DataFrame:
    return diff.consecutive_changes(table(spark, folder, "source_inventory"))


@registered("""
with r as (select company_id, run_id, lag(run_id) over (partition by company_id order by run_id) from_run from (select distinct company_id, run_id from source_inventory where company_id is not null and run_id is not null)),
v as (select company_id, from_run, run_id to_run, substr(from_run, 1, 4) fs, substr(run_id, 1, 4) ts, case when substr(from_run, 6, 1) = '0' then '' else coalesce(nullif(substr(from_run, 5, 1), '1'), 'None') end fp,
  case when substr(run_id, 6, 1) = '0' then '' else coalesce(nullif(substr(run_id, 5, 1), '1'), 'None') end tp from r where from_run is not null)
select company_id, from_run, to_run, case when fs <> ts then 'schema_delta' when fp <> tp then 'extraction_delta' else 'source_delta' end delta_type from v
""")
def delta_types(spark: SparkSession, folder: str) -> DataFrame:
    """Neighbouring runs of each company; the year of a run stands for its schemas, a digit of its month for its prompts (missing for
    some runs, null for others)."""
    runs = table(spark, folder, "source_inventory").select("company_id", "run_id").dropna().distinct()
    pairs = runs.withColumn("from_run", F.lag("run_id").over(Window.partitionBy("company_id").orderBy("run_id"))).filter("from_run is not null").withColumnRenamed("run_id", "to_run")

    def repro(run: str):
        schema = F.create_map(F.lit("schema_set_hash"), F.substring(run, 1, 4))
        return F.when(F.substring(run, 6, 1) == "0", schema).otherwise(F.map_concat(schema, F.create_map(F.lit("prompt_set_hash"), F.nullif(F.substring(run, 5, 1), F.lit("1")))))

    return diff.delta_type(pairs.withColumns({"from_repro": repro("from_run"), "to_repro": repro("to_run")})).select("company_id", "from_run", "to_run", "delta_type")


ITEMS_SQL = """
with li as (select company_id, run_id, artifact_id, source_id, line_items, periods, unnest(range(len(line_items))) i from financial_artifact),
one as (select company_id, run_id, artifact_id, source_id, i, line_items[i + 1] l, periods, list_max(list_filter(range(len(periods)), lambda j: periods[j + 1].period_id = line_items[i + 1].column_ref)) j from li),
obs as (select company_id, run_id, artifact_id, source_id, i, l.scope as scope, periods[j + 1].period_id period_id, l.normalized_candidate.taxonomy_key taxonomy_key, l.value_numeric as value,
  periods[j + 1].currency_reported currency, periods[j + 1].restated restated from one where j is not null and l.normalized_candidate.taxonomy_key is not null and l.value_numeric is not null),
g as (select company_id, run_id, scope, period_id, taxonomy_key, count(*) n_members,
  min(currency) <> max(currency) or (count(currency) > 0 and count(currency) < count(*)) c, min(restated) <> max(restated) or (count(restated) > 0 and count(restated) < count(*)) r,
  min(value) <> max(value) v, string_agg(artifact_id || ':' || i, ',' order by artifact_id, coalesce(source_id, ''), i) members, min(value) lo from obs group by all),
f as (select *, case when coalesce(c, false) then 'currency_mismatch' when coalesce(r, false) then 'restatement' when v then 'source_authority_conflict' end reason from g)
"""


@registered(ITEMS_SQL + """select company_id, run_id, scope, period_id, taxonomy_key, n_members, reason, members,
  case when reason is not null then 'cf_' || substr(sha256(coalesce(scope, 'None') || '|' || period_id || '|' || taxonomy_key), 1, 12) end conflict_id, case when reason is null then lo end as value from f""")
def merge_financials(spark: SparkSession, folder: str) -> DataFrame:
    merged = merge.merge_financials(merge.financial_observations(table(spark, folder, "financial_artifact")))
    sorted_members = F.array_sort(F.transform("members", lambda m: F.struct(m["artifact_id"].alias("a"), F.coalesce(m["source_id"], F.lit("")).alias("s"), m["line_pos"].alias("p"))))
    members = F.array_join(F.transform(sorted_members, lambda m: F.concat(m["a"], F.lit(":"), m["p"].cast("string"))), ",")
    return merged.select("company_id", "run_id", "scope", "period_id", "taxonomy_key", F.size("members").cast("long").alias("n_members"), "reason", members.alias("members"), "conflict_id", "value")


PRODUCT_SQL = """
with e as (select 'c' || p_size % 5 company_id, 'r' || p_size % 3 run_id, 'art_' || p_partkey artifact_id, 'src_' || p_size source_id, p_type entity_type, p_brand family, p_name as name, nullif(cast(p_size % 3 as varchar), '2') lifecycle_status from part where p_size <> 7),
g as (select company_id, run_id, entity_type, family, count(*) n, count(distinct coalesce(lifecycle_status, '<none>')) d, min(lifecycle_status) l, string_agg(artifact_id || '=' || name, ',' order by artifact_id, source_id) members from e group by all)
"""


def _products(spark: SparkSession, folder: str) -> DataFrame:
    """Parts as product artifacts with one entity each, a null element beside it; some have no candidate."""
    candidate = F.when(F.col("p_size") != 7, F.struct(F.col("p_brand").alias("family"), F.lit(0.9).alias("confidence")))
    entity = F.struct(F.col("p_type").alias("entity_type"), F.col("p_name").alias("source_native_name"), F.nullif((F.col("p_size") % 3).cast("string"), F.lit("2")).alias("lifecycle_status"), candidate.alias("normalized_candidate"))
    named = lambda p, c: F.concat(F.lit(p), c.cast("string"))
    return table(spark, folder, "part").select(named("c", F.col("p_size") % 5).alias("company_id"), named("r", F.col("p_size") % 3).alias("run_id"), named("art_", F.col("p_partkey")).alias("artifact_id"), named("src_", F.col("p_size")).alias("source_id"), F.array(entity, F.lit(None)).alias("entities"))


@registered(PRODUCT_SQL + """select company_id, run_id, entity_type, family, case when d > 1 then 'cf_' || substr(sha256('product|' || entity_type || '|' || family), 1, 12) end conflict_id, case when d = 1 then l end lifecycle_status, n n_members, members from g""")
def merge_products(spark: SparkSession, folder: str) -> DataFrame:
    merged = merge.merge_products(merge.product_observations(_products(spark, folder)))
    members = F.array_join(F.transform("members", lambda m: F.concat(m["artifact_id"], F.lit("="), m["value"])), ",")
    return merged.select("company_id", "run_id", "entity_type", "family", "conflict_id", "lifecycle_status", F.size("members").cast("long").alias("n_members"), members.alias("members"))


@registered(PRODUCT_SQL + "select company_id, run_id, 'product' part, count(*) filter (d = 1) merged, count(*) filter (d > 1) conflicts from g group by all union all select company_id, run_id, 'financial', count(*) filter (reason is null), count(reason) from (" + ITEMS_SQL + "select * from f) group by all")
def merged_outputs(spark: SparkSession, folder: str) -> DataFrame:
    """What each run merged and what it left in conflict, financial figures and products."""
    financials = merge.merge_financials(merge.financial_observations(table(spark, folder, "financial_artifact")))
    return merge.merged_output(financials, merge.merge_products(merge.product_observations(_products(spark, folder)))).drop("document")


REF_SQL = """select distinct company_id, run_id, artifact_id, 'source_id ' || source_id || ' not in inventory' problem from financial_artifact a
  where source_id <> '' and not exists (select 1 from source_inventory i where i.company_id = a.company_id and i.run_id = a.run_id and i.source_id = a.source_id)"""
LINEAGE_SQL = """select company_id, run_id, artifact_id, 'lineage check failed' problem from financial_artifact where not coalesce(lineage.source_snapshot_id <> '' and lineage.content_path <> '' and lineage.snippet <> ''
  and cardinality(lineage.locator) > 0 and lineage.extraction_prompt is not null, false)"""
IDS_SQL = "select company_id, run_id, artifact_id, 'duplicate artifact_id' problem from financial_artifact where artifact_id is not null group by all having count(*) > 1"
USE_SQL = """
with raw as (select row_number() over () d, * from financial_artifact),
li as (select d, company_id, run_id, artifact_id, line_items, periods, unnest(range(len(line_items))) i from raw),
one as (select d, company_id, run_id, artifact_id, line_items[i + 1] l, periods, list_max(list_filter(range(len(periods)), lambda j: periods[j + 1].period_id = line_items[i + 1].column_ref)) j from li where line_items[i + 1] is not null),
k as (select d, company_id, run_id, artifact_id, l.line_item_id as line_item_id, l.scope as scope, l.column_ref as col, coalesce(j is not null and l.column_ref <> '', false) has, cardinality(l.cell_locator) loc, periods[j + 1].currency_reported cur, periods[j + 1].unit_scale sc from one),
u as (select company_id, run_id, artifact_id, line_item_id, 'scope is null' problem from k where scope is null
union all select company_id, run_id, artifact_id, line_item_id, 'cell_locator is missing or empty' from k where coalesce(loc, 0) = 0
union all select company_id, run_id, artifact_id, line_item_id, 'column_ref not in periods' from k where col is not null and not has
union all select company_id, run_id, artifact_id, line_item_id, 'period missing currency_reported' from k where col is not null and has and coalesce(cur, '') = ''
union all select company_id, run_id, artifact_id, line_item_id, 'period missing unit_scale' from k where col is not null and has and coalesce(sc, '') = ''
union all select company_id, run_id, artifact_id, line_item_id, 'duplicate (scope, period, line_item_id)' from
  (select *, row_number() over (partition by d, company_id, run_id, artifact_id, scope, col, line_item_id) n from k) where n > 1)
"""


@registered(REF_SQL)
def gate_referential_integrity(spark: SparkSession, folder: str) -> DataFrame:
    return quality.referential_integrity(table(spark, folder, "financial_artifact"), table(spark, folder, "source_inventory"))


@registered(LINEAGE_SQL)
def gate_lineage_complete(spark: SparkSession, folder: str) -> DataFrame:
    return quality.lineage_complete(table(spark, folder, "financial_artifact"))


@registered(IDS_SQL)
def gate_id_integrity(spark: SparkSession, folder: str) -> DataFrame:
    return quality.id_integrity(table(spark, folder, "financial_artifact"))


@registered(USE_SQL + "select * from u")
def gate_financial_usability(spark: SparkSession, folder: str) -> DataFrame:
    return quality.financial_usability(table(spark, folder, "financial_artifact"))


REFRESH_SQL = STATE_SQL + """, last as (select company_id, max(run_id) run_id from source_inventory group by 1)
select s.company_id, l.run_id, s.entity_id source_id from state s join last l using (company_id) where s.status in ('active', 'reappeared')
  and not exists (select 1 from source_inventory i where i.company_id = s.company_id and i.run_id = l.run_id and i.source_id = s.entity_id)"""


@registered(REFRESH_SQL)
def gate_refresh_semantics(spark: SparkSession, folder: str) -> DataFrame:
    inv = table(spark, folder, "source_inventory")
    latest = inv.groupBy("company_id").agg(F.max("run_id").alias("run_id"))
    return quality.refresh_drops(_log(spark, folder), inv, latest)


#: Claims of dossiers stand in the artifact log here: an event is a claim that cites its artifact, an unavailable one cites nothing.
CITED_SQL = """select distinct company_id, run_id, entity_id artifact_id, 'citation not in artifact set' problem from artifact_registry l where event_type <> 'unavailable' and entity_id is not null
  and not exists (select 1 from financial_artifact a where a.company_id = l.company_id and a.run_id = l.run_id and a.artifact_id = l.entity_id)"""
UNCITED_SQL = "select company_id, run_id, cast(null as varchar) artifact_id, 'dossier claim (fact) has no citations: ' || substr(event_id, 1, 60) problem from artifact_registry where event_type = 'unavailable'"
CLOSURE_SQL = """select distinct company_id, run_id, 'structured/' || entity_id || '.json' path from artifact_registry l where event_type = 'extracted' and entity_id is not null
  and not exists (select 1 from financial_artifact a where a.company_id = l.company_id and a.run_id = l.run_id and a.artifact_id = l.entity_id)"""
ARTIFACT_ERRORS_SQL = """
with one as (select company_id, run_id, artifact_id, list_concat(list_filter([case when not regexp_matches(artifact_id, '^art_[0-9a-f]{16}$') then 'artifact_id: pattern' end, case when not regexp_matches(source_id, '^src_[0-9a-f]{16}$') then 'source_id: pattern' end,
    case when lineage is null then 'lineage: required' end], lambda x: x is not null),
  flatten(list_transform(range(len(periods)), lambda i: list_filter([case when periods[i + 1].period_type not in ('FY', 'Q', 'TTM', 'LTM', 'YTD') then 'periods/' || i || '/period_type: enum' end,
    case when periods[i + 1].unit_scale not in ('ones', 'thousands', 'millions', 'billions') then 'periods/' || i || '/unit_scale: enum' end], lambda x: x is not null))),
  flatten(list_transform(range(len(line_items)), lambda i: list_filter([case when line_items[i + 1].scope not in ('consolidated', 'segment', 'subsidiary', 'non_gaap') then 'line_items/' || i || '/scope: enum' end,
    case when line_items[i + 1].sign_convention not in ('positive', 'negative', 'as_reported') then 'line_items/' || i || '/sign_convention: enum' end,
    case when line_items[i + 1].normalized_candidate.confidence not between 0 and 1 then 'line_items/' || i || '/normalized_candidate/confidence: range' end], lambda x: x is not null)))) errors from financial_artifact)
"""
INVENTORY_ERRORS_SQL = """select company_id, run_id, source_id, unnest(list_filter([case when not regexp_matches(source_id, '^src_[0-9a-f]{16}$') then 'source_id: pattern' end,
    case when source_priority not in ('primary', 'secondary', 'signal') then 'source_priority: enum' end, case when retrieval_status not in ('ok', 'unavailable', 'error') then 'retrieval_status: enum' end,
    case when diff_class not in ('unchanged', 'cosmetic_change', 'table_change', 'content_change', 'unavailable', 'new') then 'diff_class: enum' end], lambda x: x is not null)) error from source_inventory"""


def _dossiers(spark: SparkSession, folder: str) -> DataFrame:
    kind = F.when(F.col("event_type") == "validated", "evidence").when(F.col("event_type") == "superseded", "inference").otherwise("fact")
    cited = F.when(F.col("event_type") == "unavailable", F.array().cast("array<string>")).otherwise(F.array("entity_id"))
    claims = table(spark, folder, "artifact_registry").groupBy("company_id", "run_id").agg(F.collect_list(F.struct(F.col("event_id").alias("text"), kind.alias("kind"), cited.alias("citations"))).alias("claims"))
    return claims.select("company_id", "run_id", F.array(F.struct(F.lit("log").alias("key"), F.col("claims"))).alias("sections"))


@registered(CITED_SQL + " union all " + UNCITED_SQL)
def gate_dossiers(spark: SparkSession, folder: str) -> DataFrame:
    dossiers, artifacts = _dossiers(spark, folder), table(spark, folder, "financial_artifact")
    return quality.dossier_references(dossiers, artifacts).select("company_id", "run_id", "artifact_id", "problem").unionByName(quality.uncited_claims(dossiers))


@registered(CLOSURE_SQL)
def gate_manifest_closure(spark: SparkSession, folder: str) -> DataFrame:
    """The log's extractions as the paths of the runs' manifests, against the artifacts that are there."""
    path = lambda c: F.concat(F.lit("structured/"), c, F.lit(".json")).alias("path")
    named = table(spark, folder, "artifact_registry").filter("event_type = 'extracted'").select("company_id", "run_id", path(F.col("entity_id")))
    return quality.missing_paths(named, table(spark, folder, "financial_artifact").select("company_id", "run_id", path(F.col("artifact_id")))).drop("problem")


_RUNS_SQL = "select distinct company_id, run_id from financial_artifact union select distinct company_id, run_id from source_inventory union select distinct company_id, run_id from artifact_registry"
_GATES_SQL = "['" + "', '".join(quality.GATES) + "']"
REPORT_SQL = (
    "with p as (select 'schemas_valid' gate, company_id, run_id from (" + ARTIFACT_ERRORS_SQL + "select company_id, run_id, unnest(errors) e from one) union all select 'schemas_valid', company_id, run_id from (" + INVENTORY_ERRORS_SQL + ")"
    " union all select 'referential_integrity', company_id, run_id from (" + REF_SQL + ") union all select 'referential_integrity', company_id, run_id from (" + CITED_SQL + ")"
    " union all select 'lineage_complete', company_id, run_id from (" + LINEAGE_SQL + ") union all select 'lineage_complete', company_id, run_id from (" + UNCITED_SQL + ")"
    " union all select 'id_integrity', company_id, run_id from (" + IDS_SQL + ") union all select 'financial_usability', company_id, run_id from (" + USE_SQL + "select * from u)"
    " union all select 'manifest_closure', company_id, run_id from (" + CLOSURE_SQL + ") union all select 'refresh_semantics', company_id, run_id from (" + REFRESH_SQL + ")"
    " union all select 'conflict_visibility', company_id, run_id from (" + ITEMS_SQL + "select company_id, run_id from f where reason is not null)),"
    " r as (" + _RUNS_SQL + "), g as (select unnest(" + _GATES_SQL + ") gate, unnest(range(8)) o), c as (select gate, company_id, run_id, count(*) n from p group by all),"
    " t as (select r.company_id, r.run_id, g.gate, cast(g.o as int) ordinal, c.n is null or g.gate = 'conflict_visibility' passed, coalesce(c.n, 0) n_problems from r cross join g"
    " left join c on c.gate = g.gate and c.company_id is not distinct from r.company_id and c.run_id is not distinct from r.run_id)"
)


@registered(REPORT_SQL + " select * from t")
def gate_report(spark: SparkSession, folder: str) -> DataFrame:
    """All eight gates of every run that has artifacts, an inventory or a log."""
    artifacts, inventory, dossiers = table(spark, folder, "financial_artifact"), table(spark, folder, "source_inventory"), _dossiers(spark, folder)
    problems = {
        "schemas_valid": validate.invalid_rows(artifacts, "financial_artifact", quality.RUN).unionByName(validate.invalid_rows(inventory, "source_inventory", quality.RUN)),
        "referential_integrity": quality.referential_integrity(artifacts, inventory, dossiers), "lineage_complete": quality.lineage_complete(artifacts, dossiers), "id_integrity": gate_id_integrity(spark, folder),
        "financial_usability": gate_financial_usability(spark, folder), "manifest_closure": gate_manifest_closure(spark, folder), "refresh_semantics": gate_refresh_semantics(spark, folder), "conflict_visibility": quality.conflicts(artifacts),
    }
    runs = [t.select(*quality.RUN) for t in (artifacts, inventory, table(spark, folder, "artifact_registry"))]
    return quality.gate_report(runs[0].unionByName(runs[1]).unionByName(runs[2]), problems)


@registered(REPORT_SQL + " select company_id, run_id, bool_and(passed) passed from t group by all")
def run_verdicts(spark: SparkSession, folder: str) -> DataFrame:
    return quality.runs_passed(gate_report(spark, folder))


@registered("select distinct company_id, run_id, artifact_id, source_id from financial_artifact where source_id <> ''")
def referenced_sources(spark: SparkSession, folder: str) -> DataFrame:
    return quality.referenced_sources(table(spark, folder, "financial_artifact"))


@registered(f"""select distinct company_id, run_id, source_id, last_seen_at from source_inventory where try_cast(regexp_replace(last_seen_at, 'Z$', '') as timestamp) < timestamp '{NOW}' - interval 180 days""")
def stale_sources(spark: SparkSession, folder: str) -> DataFrame:
    return quality.stale_sources(table(spark, folder, "source_inventory"), NOW)


CONFIDENCE_SQL = "with c as (select artifact_id, unnest(list_transform(line_items, lambda l: l.normalized_candidate.confidence)) confidence from financial_artifact)"


@registered(CONFIDENCE_SQL + " select artifact_id, count(*) n_low, min(confidence) lowest from c where confidence < 0.5 group by 1")
def low_confidence(spark: SparkSession, folder: str) -> DataFrame:
    items = table(spark, folder, "financial_artifact").select("artifact_id", F.explode(F.transform("line_items", lambda i: i["normalized_candidate"]["confidence"])).alias("confidence"))
    return quality.low_confidence(items).groupBy("artifact_id").agg(F.count("*").alias("n_low"), F.min("confidence").alias("lowest"))


@registered(CONFIDENCE_SQL + " select count(*) n_items, count(confidence) n_scored, min(confidence) lowest, max(confidence) highest, round(avg(confidence), 6) mean from c")
def confidence_summary(spark: SparkSession, folder: str) -> DataFrame:
    c = table(spark, folder, "financial_artifact").select(F.explode(F.transform("line_items", lambda i: i["normalized_candidate"]["confidence"])).alias("confidence"))
    return c.agg(F.count("*").alias("n_items"), F.count("confidence").alias("n_scored"), F.min("confidence").alias("lowest"), F.max("confidence").alias("highest"), F.round(F.avg("confidence"), 6).alias("mean"))


@registered("""with r as (select distinct company_id, run_id from source_inventory), e as (select unnest(['business_register', 'regulatory_filing', 'sanctions_list']) source_class)
select r.company_id, r.run_id, e.source_class from r cross join e where not exists (select 1 from source_inventory i where i.company_id = r.company_id and i.run_id = r.run_id and i.source_class = e.source_class and i.source_priority = 'primary')""")
def missing_classes(spark: SparkSession, folder: str) -> DataFrame:
    return quality.missing_classes(table(spark, folder, "source_inventory"), ["business_register", "regulatory_filing", "sanctions_list"])


@registered("select source_id, error, count(*) n from (" + INVENTORY_ERRORS_SQL + ") group by all")
def validate_inventory(spark: SparkSession, folder: str) -> DataFrame:
    return validate.invalid_rows(table(spark, folder, "source_inventory"), "source_inventory", ["source_id"]).groupBy("source_id", "error").agg(F.count("*").alias("n"))


@registered("""
with m as (select event_id, list_filter([case when event_id is null then 'event_id: required' end, case when event_time is null then 'event_time: required' end, case when run_id is null then 'run_id: required' end,
  case when entity_type is null then 'entity_type: required' end, case when entity_id is null then 'entity_id: required' end, case when event_type is null then 'event_type: required' end, case when payload is null then 'payload: required' end,
  case when entity_type not in ('source') then 'entity_type: enum' end, case when event_type not in ('discovered', 'retrieved', 'canonicalized', 'unavailable', 'superseded', 'validated') then 'event_type: enum' end], lambda x: x is not null) e from example_source_registry)
select unnest(e) error, count(*) n from m group by 1
""")
def validate_events(spark: SparkSession, folder: str) -> DataFrame:
    return validate.invalid_rows(_log(spark, folder), "source_event", ["event_id"]).groupBy("error").agg(F.count("*").alias("n"))


@registered(ARTIFACT_ERRORS_SQL + "select artifact_id, unnest(errors) error from one")
def validate_artifacts(spark: SparkSession, folder: str) -> DataFrame:
    return validate.invalid_rows(table(spark, folder, "financial_artifact"), "financial_artifact", ["artifact_id"])


_NORM = "trim(regexp_replace(regexp_replace(lower({x}), '[!-/:-@\\[-`{{-~]+', ' ', 'g'), '\\s+', ' ', 'g'))"
_ALIASES = "list_filter(list_transform(regexp_extract_all(case when trim(remarks) = '-0-' then '' else coalesce(remarks, '') end, '(?i)\\b(?:a\\.k\\.a\\.|aka|f\\.k\\.a\\.|fka|n\\.k\\.a\\.|nka)\\b[\\s:]*[''\"]?([^;''\"]+?)[''\"]?\\s*(?:;|$)', 1), lambda a: trim(a)), lambda a: a <> '')"


@registered(f"""
with q as (select distinct name query from watchlist_entry where name is not null), qn as (select query, {_NORM.format(x='query')} norm from q),
e as (select distinct cast(ent_num as varchar) entry_key, unnest(list_concat([coalesce(sdn_name, '')], {_ALIASES})) n from sdn_entry), en as (select distinct entry_key, {_NORM.format(x='n')} norm from e),
qt as (select query, norm, list_distinct(list_filter(string_split(norm, ' '), lambda t: t <> '')) t from qn), et as (select entry_key, norm, list_distinct(list_filter(string_split(norm, ' '), lambda t: t <> '')) t from en),
m as (select query, entry_key, 0 r from qn join en using (norm) union all select query, entry_key, 1 from qt join et on len(qt.t) > 1 and list_has_all(et.t, qt.t))
select query, entry_key, case min(r) when 0 then 'exact' else 'partial' end match_type from m group by 1, 2
""")
def screen_names(spark: SparkSession, folder: str) -> DataFrame:
    """Every name of the watch lists against the sanctions list with the aliases of its remarks."""
    entries = screening.sdn_entries(table(spark, folder, "sdn_entry")).dropDuplicates()
    queries = table(spark, folder, "watchlist_entry").select(F.col("name").alias("query")).filter("query is not null")
    return screening.screen(queries, entries)


@registered(f"""select distinct cast(ent_num as varchar) entry_key, coalesce(case when trim(sdn_type) = '-0-' then null else sdn_type end, '') as type,
  array_to_string(list_filter(list_transform(string_split(coalesce(program, ''), '] ['), lambda p: regexp_replace(trim(p), '^[\\[\\]]+|[\\[\\]]+$', '', 'g')), lambda p: p <> ''), '; ') program, array_to_string({_ALIASES}, '|') aliases from sdn_entry""")
def sdn_list(spark: SparkSession, folder: str) -> DataFrame:
    return screening.sdn_entries(table(spark, folder, "sdn_entry")).select("entry_key", "type", "program", F.array_join("aliases", "|").alias("aliases")).distinct()


@registered("""with c as (select event_id, event_id as flat from events)
select event_id, 'd0_' || cast((flat // (25 * 1000000)) % 5 as varchar) d0, 'd1_' || cast((flat // 1000000) % 25 as varchar) d1, 'd2_' || cast(flat % 1000000 as varchar) d2 from c""")
def jsonstat_decode(spark: SparkSession, folder: str) -> DataFrame:
    """Flat indexes of a cube to positions, as in JSON-stat."""
    pos = indicators.positions(F.col("event_id"), F.array(F.lit(5).cast("long"), F.lit(25).cast("long"), F.lit(1000000).cast("long")))
    rows = table(spark, folder, "events").select("event_id", pos.alias("p"))
    return rows.select("event_id", *[F.concat(F.lit(f"d{i}_"), F.col("p")[i].cast("string")).alias(f"d{i}") for i in range(3)])


@registered("""select n_nationkey, r_name area, n_name series from nation join region on n_regionkey = r_regionkey""")
def sdmx_decode(spark: SparkSession, folder: str) -> DataFrame:
    """Colon keys of positions back to codes, as in SDMX-JSON; the code lists are the region and nation tables."""
    codes = F.array_sort(F.collect_list(F.struct("k", "c")))
    lists = [table(spark, folder, t).select(F.col(f"{x}_{t}key").alias("k"), F.col(f"{x}_name").alias("c")).agg(F.transform(codes, lambda s: s["c"]).alias(t)) for t, x in (("region", "r"), ("nation", "n"))]
    keyed = table(spark, folder, "nation").select("n_nationkey", F.concat_ws(":", "n_regionkey", "n_nationkey").alias("key"))
    wide = keyed.join(F.broadcast(lists[0])).join(F.broadcast(lists[1]))  # one row each
    coded = indicators.codes_at(F.col("key"), F.array("region", "nation"))
    return wide.select("n_nationkey", coded[0].alias("area"), coded[1].alias("series"))


@registered("""select o_custkey, coalesce(arg_min(o_orderpriority, o_orderkey) filter (o_orderstatus <> 'F'), arg_min(o_orderpriority, o_orderkey)) current from orders group by 1""")
def first_current(spark: SparkSession, folder: str) -> DataFrame:
    """The first entry without an end in a list, else the first: orders as the names of a customer."""
    entry = F.struct("o_orderkey", F.col("o_orderpriority").alias("name"), F.when(F.col("o_orderstatus") == "F", "ended").alias("endDate"))
    lists = table(spark, folder, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list(entry)).alias("names"))
    return lists.select("o_custkey", connectors.current_name(F.col("names")).alias("current"))


@registered("select c_custkey, c_name, '[REDACTED]' c_acctbal, c_mktsegment from customer")
def redacted_export(spark: SparkSession, folder: str) -> DataFrame:
    return pystr.redact(table(spark, folder, "customer").select("c_custkey", "c_name", "c_acctbal", "c_mktsegment"), ["c_acctbal"])


@registered("""with r as (select distinct record_id, name, jurisdiction, status, address from registry_record)
select distinct record_id, jurisdiction, case when address is null then 'None' else address end address, array_to_string(list_filter([name, status, address], lambda x: x is not null and x <> ''), ', ') label from r""")
def registry_export(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "registry_record").select("record_id", "name", "jurisdiction", "status", "address").distinct()
    return rows.select("record_id", "jurisdiction", pystr.export_text(F.col("address"), rows.schema["address"].dataType).alias("address"), names.join_parts(", ", F.col("name"), F.col("status"), F.col("address")).alias("label")).distinct()
