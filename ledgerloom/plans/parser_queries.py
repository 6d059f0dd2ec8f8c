"""Registered queries of the parsers: the tables are written as responses or list files of each provider and read back, and the SQL says
what must come out.  All run over whole tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.operators import schemas
from ledgerloom.session import own_path, table
from ledgerloom.sources import connectors, indicators, lists

QUERIES, SQL = {}, {}


def registered(sql: str):
    def add(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return add


def _json(*fields: Column) -> Column:
    return F.to_json(F.struct(*fields))


def _records(spark: SparkSession, folder: str, source: str) -> DataFrame:
    return table(spark, folder, "registry_record").filter(F.col("source") == source).select("reg_number", "name", "status", "address", "url").distinct()


_REGISTER = "select distinct '{s}' source, '{j}' jurisdiction, coalesce(reg_number, '') reg_number, coalesce(name, '') as name, {status} status, {address} address, {url} url from registry_record where source = '{s}'"


@registered(_REGISTER.format(s="BRREG", j="NO", status="case when status = 'bankrupt' then 'bankrupt' else 'active' end", address="nullif(address, '')", url="cast(null as varchar)"))
def brreg_records(spark: SparkSession, folder: str) -> DataFrame:
    """One response per record, as the Norwegian register gives it."""
    unit = F.struct(F.col("reg_number").alias("organisasjonsnummer"), F.col("name").alias("navn"), (F.col("status") == "bankrupt").alias("konkurs"), F.struct(F.array("address").alias("adresse")).alias("forretningsadresse"))
    return connectors.brreg(_records(spark, folder, "BRREG").select(_json(F.struct(F.array(unit).alias("enheter")).alias("_embedded")).alias("raw"))).distinct()


@registered(_REGISTER.format(s="ARES", j="CZ", status="cast(null as varchar)", address="nullif(address, '')", url="cast(null as varchar)") + " and reg_number <> ''")
def ares_records(spark: SparkSession, folder: str) -> DataFrame:
    rows = _records(spark, folder, "ARES")
    return connectors.ares(rows.select(_json(F.col("reg_number").alias("ico"), F.col("name").alias("obchodniJmeno"), F.struct(F.col("address").alias("textovaAdresa")).alias("sidlo")).alias("raw"))).distinct()


@registered(_REGISTER.format(s="PRH", j="FI", status="nullif(status, '')", address="cast(null as varchar)", url="cast(null as varchar)"))
def prh_records(spark: SparkSession, folder: str) -> DataFrame:
    """The name stands behind an ended one."""
    old = F.struct(F.lit("Old name").alias("name"), F.lit("2001-01-01").alias("endDate"))
    firm = F.struct(F.struct(F.col("reg_number").alias("value")).alias("businessId"), F.col("status").alias("tradeRegisterStatus"), F.array(old, F.struct(F.coalesce("name", F.lit("")).alias("name"), F.lit(None).cast("string").alias("endDate"))).alias("names"))
    return connectors.prh(_records(spark, folder, "PRH").select(_json(F.array(firm).alias("companies")).alias("raw"))).distinct()


@registered(_REGISTER.format(s="ARIREGISTER", j="EE", status="nullif(status, '')", address="nullif(address, '')", url="nullif(url, '')"))
def ariregister_records(spark: SparkSession, folder: str) -> DataFrame:
    firm = F.struct(F.col("reg_number").alias("reg_code"), "name", "status", F.col("address").alias("legal_address"), "url")
    return connectors.ariregister(_records(spark, folder, "ARIREGISTER").select(_json(F.array(firm).alias("data")).alias("raw"))).distinct()


@registered("select distinct coalesce(reg_number, '') company_number, coalesce(name, '') title, coalesce(status, '') status, coalesce(address, '') address from registry_record where source = 'COMPANIES_HOUSE'")
def companies_house_items(spark: SparkSession, folder: str) -> DataFrame:
    item = F.struct(F.col("reg_number").alias("company_number"), F.col("name").alias("title"), F.col("status").alias("company_status"), F.col("address").alias("address_snippet"))
    return connectors.companies_house(_records(spark, folder, "COMPANIES_HOUSE").select(_json(F.array(item).alias("items")).alias("raw"))).distinct()


@registered("select distinct coalesce(lei, '') lei, coalesce(legal_name, '') legal_name, coalesce(country, '') country, coalesce(status, '') status from lei_record")
def gleif_records(spark: SparkSession, folder: str) -> DataFrame:
    entity = F.struct(F.struct(F.col("legal_name").alias("name")).alias("legalName"), F.struct("country").alias("legalAddress"), "status")
    rows = table(spark, folder, "lei_record").select(_json(F.array(F.struct(F.struct("lei", entity.alias("entity")).alias("attributes"))).alias("data")).alias("raw"))
    return connectors.gleif(rows).distinct()


@registered("select coalesce(source, '') as domain, coalesce(substr(text, 1, 60), '') title, coalesce(lang, '') as language, cast(doc_id as varchar) url, '' seendate from documents")
def gdelt_articles(spark: SparkSession, folder: str) -> DataFrame:
    article = F.struct(F.col("doc_id").cast("string").alias("url"), F.substring("text", 1, 60).alias("title"), F.col("source").alias("domain"), F.col("lang").alias("language"))
    return connectors.gdelt(table(spark, folder, "documents").select(_json(F.array(article).alias("articles")).alias("raw")))


@registered("select distinct cast(ent_num as varchar) qid, coalesce(sdn_name, '') as label, coalesce(program, '') description from sdn_entry")
def wikidata_hits(spark: SparkSession, folder: str) -> DataFrame:
    """Half of the hits have their label only in the display part."""
    shown = F.struct(F.struct(F.col("sdn_name").alias("value")).alias("label"), F.struct(F.col("program").alias("value")).alias("description"))
    hit = F.struct(F.col("ent_num").cast("string").alias("id"), F.when(F.col("ent_num") % 2 == 0, F.col("sdn_name")).alias("label"), shown.alias("display"))
    return connectors.wikidata_search(table(spark, folder, "sdn_entry").select(_json(F.array(hit).alias("search")).alias("raw"))).distinct()


@registered("select lei qid, max(registered_as) as lei_value, max(country) country from lei_record where registered_as is not null and country is not null group by lei")
def wikidata_properties(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "lei_record").filter("registered_as is not null and country is not null").groupBy("lei").agg(F.max("registered_as").alias("r"), F.max("country").alias("c"))

    def claim(kind: str, value: Column) -> Column:
        return F.array(F.struct(F.struct(F.lit("value").alias("snaktype"), F.struct(F.lit(kind).alias("type"), value.alias("value")).alias("datavalue")).alias("mainsnak")))

    body = F.concat(F.lit('{"entities":{"'), "lei", F.lit('":{"claims":{"P1278":'), F.to_json(claim("string", F.col("r"))), F.lit(',"P17":'), F.to_json(claim("wikibase-entityid", F.struct(F.col("c").alias("id")))), F.lit("}}}}"))
    facts = connectors.wikidata_facts(rows.select(F.col("lei").alias("qid"), body.alias("raw")))
    return facts.select("qid", F.col("facts")["lei"][0].alias("lei_value"), F.col("facts")["country"][0].alias("country"))


@registered("select cast(o_orderkey as varchar) accession, case o_orderstatus when 'F' then '10-K' else '20-F' end form, cast(o_orderdate as varchar) filed, o_orderpriority description from orders where o_orderstatus in ('F', 'O')")
def edgar_submissions(spark: SparkSession, folder: str) -> DataFrame:
    """Orders as filings of a customer; forms that are not asked for stay out."""
    orders = table(spark, folder, "orders").select("o_custkey", F.col("o_orderkey").cast("string").alias("a"), F.when(F.col("o_orderstatus") == "F", "10-K").when(F.col("o_orderstatus") == "O", "20-F").otherwise("8-K").alias("f"), F.col("o_orderdate").cast("string").alias("d"), F.col("o_orderpriority").alias("p"))
    each = orders.groupBy("o_custkey").agg(F.collect_list(F.struct("a", "f", "d", "p")).alias("l"))
    pick = lambda x: F.transform("l", lambda r: r[x])
    recent = F.struct(pick("a").alias("accessionNumber"), pick("f").alias("form"), pick("d").alias("filingDate"), pick("p").alias("primaryDocDescription"))
    return connectors.edgar_filings(each.select(_json(F.struct(recent.alias("recent")).alias("filings")).alias("raw")))


_OBSERVED = "select '{s}' as source, {series} series, {area} area, {period} period, usd_per_unit as value from fx_rate"


def _rates(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "fx_rate").withColumn("v", F.col("usd_per_unit").cast("string")).withColumn("y", F.col("fiscal_year").cast("string"))


def _short(df: DataFrame) -> DataFrame:
    return df.select("source", "series", "area", "period", "value")


@registered(_OBSERVED.format(s="BLS", series="currency_code", area="cast(null as varchar)", period="fiscal_year || '-A01'"))
def bls_series(spark: SparkSession, folder: str) -> DataFrame:
    each = _rates(spark, folder).groupBy("currency_code").agg(F.collect_list(F.struct(F.col("y").alias("year"), F.lit("A01").alias("period"), F.lit("Annual").alias("periodName"), F.col("v").alias("value"))).alias("data"))
    raw = each.select(_json(F.lit("REQUEST_SUCCEEDED").alias("status"), F.struct(F.array(F.struct(F.col("currency_code").alias("seriesID"), "data")).alias("series")).alias("Results")).alias("raw"))
    return _short(indicators.bls(raw))


@registered(_OBSERVED.format(s="WORLD_BANK", series="'FX'", area="currency_code", period="cast(fiscal_year as varchar)"))
def world_bank_rows(spark: SparkSession, folder: str) -> DataFrame:
    row = F.struct(F.struct(F.lit("FX").alias("id"), F.lit("Rate").alias("value")).alias("indicator"), F.col("currency_code").alias("countryiso3code"), F.col("y").alias("date"), F.col("usd_per_unit").alias("value"))
    each = _rates(spark, folder).groupBy("fiscal_year").agg(F.to_json(F.collect_list(row)).alias("rows"))
    return _short(indicators.world_bank(each.select(F.concat(F.lit('[{"page":1},'), "rows", F.lit("]")).alias("raw"))))


def _cube(spark: SparkSession, folder: str) -> DataFrame:
    """One row: codes, years and the rates as (flat index, value) of their cube; the table is small and fixed."""
    rates = _rates(spark, folder)
    axes = rates.agg(F.array_sort(F.collect_set("currency_code")).alias("codes"), F.array_sort(F.collect_set("y")).alias("years"))
    placed = rates.join(F.broadcast(axes)).select("codes", "years", (F.array_position("codes", F.col("currency_code")) - 1).alias("c"), (F.array_position("years", F.col("y")) - 1).alias("t"), "usd_per_unit")  # one row joined
    return placed.groupBy("codes", "years").agg(F.collect_list(F.struct("c", "t", F.col("usd_per_unit").alias("v"))).alias("cells"))


@registered(_OBSERVED.format(s="EUROSTAT", series="'FX'", area="currency_code", period="cast(fiscal_year as varchar)"))
def eurostat_cube(spark: SparkSession, folder: str) -> DataFrame:
    cube = _cube(spark, folder)
    index = lambda names: F.struct(F.struct(F.map_from_arrays(names, F.transform(names, lambda _, i: i)).alias("index")).alias("category"))
    dims = F.create_map(F.lit("na_item"), index(F.array(F.lit("FX"))), F.lit("geo"), index(F.col("codes")), F.lit("time"), index(F.col("years")))
    values = F.map_from_entries(F.transform("cells", lambda x: F.struct((x["c"] * F.size("years") + x["t"]).cast("string"), x["v"])))
    raw = cube.select(_json(F.lit("Rates").alias("label"), F.array(F.lit("na_item"), F.lit("geo"), F.lit("time")).alias("id"), F.array(F.lit(1), F.size("codes"), F.size("years")).alias("size"), values.alias("value"), dims.alias("dimension")).alias("raw"))
    return _short(indicators.eurostat(raw))


@registered(_OBSERVED.format(s="OECD", series="'FX'", area="currency_code", period="cast(fiscal_year as varchar)"))
def oecd_dataset(spark: SparkSession, folder: str) -> DataFrame:
    cube = _cube(spark, folder)
    axis = lambda name, ids: F.struct(F.lit(name).alias("id"), F.transform(ids, lambda i: F.struct(i.alias("id"))).alias("values"))
    observed = F.map_from_entries(F.transform("cells", lambda x: F.struct(F.concat_ws(":", x["c"].cast("string"), F.lit("0"), x["t"].cast("string")), F.array(x["v"]))))
    structure = F.struct(F.lit("Rates").alias("name"), F.struct(F.array(axis("REF_AREA", F.col("codes")), axis("MEASURE", F.array(F.lit("FX"))), axis("TIME_PERIOD", F.col("years"))).alias("observation")).alias("dimensions"))
    return _short(indicators.oecd(cube.select(_json(F.struct(F.array(structure).alias("structures"), F.array(F.struct(observed.alias("observations"))).alias("dataSets")).alias("data")).alias("raw"))))


_ALIASES = "list_filter(list_transform(regexp_extract_all(case when trim(remarks) = '-0-' then '' else coalesce(remarks, '') end, '(?i)\\b(?:a\\.k\\.a\\.|aka|f\\.k\\.a\\.|fka|n\\.k\\.a\\.|nka)\\b[\\s:]*[''\"]?([^;''\"]+?)[''\"]?\\s*(?:;|$)', 1), lambda a: trim(a)), lambda a: a <> '')"


@registered(f"""select cast(ent_num as varchar) entry_id, trim(sdn_name) as name, coalesce(nullif(trim(sdn_type), '-0-'), '') as type, nullif(trim(remarks), '-0-') remarks, array_to_string({_ALIASES}, '|') aliases,
  array_to_string(list_filter(list_transform(string_split(coalesce(program, ''), '] ['), lambda p: regexp_replace(trim(p), '^[\\[\\]]+|[\\[\\]]+$', '', 'g')), lambda p: p <> ''), '; ') program
  from (select distinct * replace (strip_accents(sdn_name) as sdn_name, strip_accents(remarks) as remarks) from sdn_entry where ent_num is not null)""")
def sdn_file(spark: SparkSession, folder: str) -> DataFrame:
    """The sanctions list as its headerless file, whose encoding holds no letters beyond Latin-1 (accents are dropped before)."""
    path, plain = own_path(spark, "sdn"), lambda c: F.translate(c, "ÁÉÍÓÖÜáéíóöü", "AEIOOUaeioou").alias(c)
    rows = table(spark, folder, "sdn_entry").filter("ent_num is not null").select("ent_num", plain("sdn_name"), *[c for c in lists.SDN_COLUMNS[2:-1]], plain("remarks")).distinct()
    rows.write.csv(path, encoding="ISO-8859-1", quoteAll=True, escape='"', emptyValue="", nullValue="")
    return lists.sdn_csv(spark, path).select("entry_id", "name", "type", "program", "remarks", F.array_join("aliases", "|").alias("aliases"))


_ENTRIES = """with e as (select distinct entry_id, coalesce(name, '') as name, coalesce(entry_type, '') as t, coalesce(program, '') p, coalesce(list_filter(aliases, lambda a: trim(a) <> ''), []) l from watchlist_entry where entry_id is not null),
o as (select entry_id, arg_min({'n': name, 't': t, 'p': p, 'l': l}, md5(entry_id || name || t || p || array_to_string(l, '|'))) r from e group by 1)
"""


def _listed(spark: SparkSession, folder: str) -> DataFrame:
    """One row per entry of the watch lists: a repeated entry with other content counts once, told by a hash."""
    empty = F.array().cast("array<string>")
    e = table(spark, folder, "watchlist_entry").filter("entry_id is not null").select("entry_id", *[F.coalesce(c, F.lit("")).alias(a) for c, a in (("name", "name"), ("entry_type", "t"), ("program", "p"))], F.coalesce(F.filter("aliases", lambda a: a.isNotNull() & (F.trim(a) != "")), empty).alias("l"))
    one = e.groupBy("entry_id").agg(F.min_by(F.struct("name", "t", "p", "l"), F.md5(F.concat("entry_id", "name", "t", "p", F.array_join("l", "|")))).alias("r"))
    return one.select("entry_id", "r.*")


def _csv(rows: DataFrame, tag: str, sep: str, header: list[str]) -> str:
    """One file with a header of our own: the columns (key, n) order the lines and are left out."""
    spark, path = rows.sparkSession, own_path(rows.sparkSession, tag)
    cells = [c for c in rows.columns if c not in ("key", "n")]
    quoted = F.concat_ws(sep, *[F.concat(F.lit('"'), F.replace(F.coalesce(c, F.lit("")), F.lit('"'), F.lit('""')), F.lit('"')) for c in cells])
    top = spark.createDataFrame([("", i, line) for i, line in enumerate(header)], "key string, n int, value string")
    lines = rows.select("key", "n", quoted.alias("value")).unionByName(top)
    lines.coalesce(1).sortWithinPartitions(F.col("key") != "", "key", "n").select("value").write.text(path)
    return path


def _named(spark: SparkSession, folder: str) -> DataFrame:
    """A line per name of an entry: the main name first, the aliases in their order."""
    return _listed(spark, folder).select("entry_id", "t", "p", F.posexplode(F.concat(F.array("name"), "l")).alias("n", "name"))


@registered(_ENTRIES + "select entry_id, trim(r.n) as name, trim(r.t) as type, trim(r.p) program, array_to_string(list_transform(r.l, lambda a: trim(a)), '|') aliases from o where trim(r.n) <> ''")
def eu_file(spark: SparkSession, folder: str) -> DataFrame:
    """The watch lists in the shape of the European file; a name holds a line break inside its quotes."""
    rows = _named(spark, folder).select(F.col("entry_id").alias("key"), "n", "entry_id", "t", "p", F.col("name").alias("w"), F.concat(F.lit("a;b\n"), "n").alias("x"))
    path = _csv(rows, "eu", ";", ["Entity_logical_id;Subject_type;Programme;Naal_wholename;Remark"])
    return lists.eu_csv(spark, path).select("entry_id", "name", "type", "program", F.array_join("aliases", "|").alias("aliases"))


@registered(_ENTRIES + "select entry_id, trim(regexp_replace(r.n, '\\s+', ' ', 'g')) as name, trim(r.t) as type, trim(r.p) program, array_to_string(list_transform(r.l, lambda a: trim(regexp_replace(a, '\\s+', ' ', 'g'))), '|') aliases from o")
def uk_file(spark: SparkSession, folder: str) -> DataFrame:
    """The watch lists in the shape of the British file, under a preamble."""
    kind = F.when(F.col("n") == 0, "Primary Name").otherwise("Alias")
    rows = _named(spark, folder).select(F.col("entry_id").alias("key"), "n", "entry_id", F.col("name").alias("n6"), kind.alias("k"), "t", "p")
    path = _csv(rows, "uk", ",", ["Report Date: 1 Jan", "Unique ID,Name 6,Name type,Type of entity,Regime Name"])
    return lists.uk_csv(spark, path).select("entry_id", "name", "type", "program", F.array_join("aliases", "|").alias("aliases"))


@registered(_ENTRIES + "select entry_id, r.n as name, r.t as type, r.p program, array_to_string(list_transform(r.l, lambda a: trim(a)), '|') aliases from o")
def bis_file(spark: SparkSession, folder: str) -> DataFrame:
    item = F.struct(F.col("entry_id").alias("id"), "name", F.col("t").alias("source"), F.array("p").alias("programs"), F.col("l").alias("alt_names"))
    return lists.bis_json(_listed(spark, folder).select(_json(F.array(item).alias("results")).alias("raw"))).select("entry_id", "name", "type", "program", F.array_join("aliases", "|").alias("aliases"))


@registered(_ENTRIES + "select entry_id, trim(r.n) as name, 'entity' as type, r.p program, array_to_string(list_transform(r.l, lambda a: trim(a)), '|') aliases from o")
def un_file(spark: SparkSession, folder: str) -> DataFrame:
    """All entries as entities of the United Nations' list."""
    path = own_path(spark, "un")
    rows = _listed(spark, folder).select(F.col("entry_id").alias("DATAID"), F.col("name").alias("FIRST_NAME"), F.col("p").alias("UN_LIST_TYPE"), F.transform("l", lambda a: F.struct(a.alias("ALIAS_NAME"))).alias("ENTITY_ALIAS"))
    rows.write.option("rowTag", "ENTITY").option("rootTag", "CONSOLIDATED_LIST").xml(path)
    return lists.un_xml(spark, path).select("entry_id", "name", "type", "program", F.array_join("aliases", "|").alias("aliases"))


_MANIFEST = """with r as (select company_id, run_id, count(*) n, count(*) filter (retrieval_status = 'ok') ok, min(title) t from source_inventory where company_id is not null and run_id is not null group by 1, 2),
e as (select company_id, run_id, unnest(list_filter([case when n % 3 = 0 then 'mode: enum' end, case when n % 2 = 0 then 'extra: additionalProperties' end, case when n % 5 = 0 then 'company_name: required' end,
  case when n % 5 <> 0 and coalesce(t, '') = '' then 'company_name: minLength' end, case when ok > 5 then 'sources_new: range' end, 'sources_changed: type'], lambda x: x is not null)) error from r)
"""


def _manifests(spark: SparkSession, folder: str) -> DataFrame:
    """A manifest per run of the inventory, some of them wrong in ways that its rows decide."""
    runs = table(spark, folder, "source_inventory").dropna(subset=["company_id", "run_id"]).groupBy("company_id", "run_id").agg(F.count("*").alias("n"), F.count_if(F.col("retrieval_status") == "ok").alias("ok"), F.min("title").alias("t"))
    nothing = F.lit(None).cast("string")
    repro = F.struct(*[nothing.alias(k) for k in ("prompt_set_hash", "schema_set_hash", "model_id", "locale")], F.create_map(F.lit("a"), F.lit("b")).alias("tool_versions"), F.create_map(F.lit("a"), F.lit("b")).alias("normalizer_profile_versions"))
    fields = [
        F.col("run_id"), F.col("company_id"), F.lit("2026-01-01T00:00:00Z").alias("started_at"), nothing.alias("completed_at"), F.when(F.col("n") % 3 == 0, "other").otherwise("full_refresh").alias("mode"),
        F.create_map(F.lit("a"), F.lit("b")).alias("input_parameters"), repro.alias("reproducibility"), F.col("n").alias("sources_discovered"), F.col("ok").alias("sources_retrieved"), F.when(F.col("ok") > 5, -1).otherwise(0).alias("sources_new"), F.lit("0").alias("sources_changed"),
        F.lit(0).alias("sources_unavailable"), F.lit(0).alias("artifacts_extracted"), F.lit(True).alias("schemas_validated"), *[F.array().cast("array<string>").alias(k) for k in ("output_paths", "warnings", "errors")],
    ]
    body = F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})
    title = F.to_json(F.array(F.coalesce("t", F.lit(""))))
    named = F.when(F.col("n") % 5 == 0, body).otherwise(F.concat(F.lit('{"company_name":'), title.substr(F.lit(2), F.length(title) - 2), F.lit(","), F.substring(body, 2, 1 << 30)))
    return runs.select("company_id", "run_id", F.when(F.col("n") % 2 == 0, F.concat(F.lit('{"extra":1,'), F.substring(named, 2, 1 << 30))).otherwise(named).alias("raw"))


@registered(_MANIFEST + "select * from e")
def validate_manifests(spark: SparkSession, folder: str) -> DataFrame:
    return _manifests(spark, folder).select("company_id", "run_id", F.explode(schemas.json_errors(F.col("raw"), "run_manifest")).alias("error"))


@registered(_MANIFEST + "select * from e where error like '%: required'")
def structural_manifests(spark: SparkSession, folder: str) -> DataFrame:
    """The degraded check finds the missing fields only."""
    return _manifests(spark, folder).select("company_id", "run_id", F.explode(schemas.structural_errors(F.col("raw"), "run_manifest")).alias("error"))
