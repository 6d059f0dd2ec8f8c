"""Watch lists in their published formats as entries (list, entry_id, name, type, program, remarks, aliases)."""

from __future__ import annotations

import csv

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions.names import clean_programme, null_token, remark_aliases

#: Columns of the headerless sanctions list (a fixed order).
SDN_COLUMNS = ["ent_num", "sdn_name", "sdn_type", "program", "title", "call_sign", "vess_type", "tonnage", "grt", "vess_flag", "vess_owner", "remarks"]
ENTRY = ["list", "entry_id", "name", "type", "program", "remarks", "aliases"]


def _filled(c: Column) -> Column:
    return F.filter(c, lambda x: x.isNotNull() & (F.trim(x) != ""))


def sdn_csv(spark: SparkSession, path: str) -> DataFrame:
    """latin-1, no header, twelve columns; short rows are filled with ''."""
    schema = ", ".join(f"{c} string" for c in SDN_COLUMNS)
    rows = spark.read.schema(schema).csv(path, encoding="ISO-8859-1", header=False, multiLine=True, quote='"', escape='"').na.fill("")
    remarks = null_token(F.col("remarks"))
    out = rows.filter(F.concat(*SDN_COLUMNS) != "").select(
        F.lit("OFAC-SDN").alias("list"), F.trim("ent_num").alias("entry_id"), F.trim("sdn_name").alias("name"), F.coalesce(null_token(F.trim("sdn_type")), F.lit("")).alias("type"),
        clean_programme(F.col("program")).alias("program"), remarks.alias("remarks"), remark_aliases(remarks).alias("aliases"),
    )
    return out.select(*ENTRY)


def un_xml(spark: SparkSession, path: str) -> DataFrame:
    """Individuals, then entities."""
    one = "struct<ALIAS_NAME: string>"
    parts = []
    for tag, names in (("INDIVIDUAL", ["FIRST_NAME", "SECOND_NAME", "THIRD_NAME"]), ("ENTITY", ["FIRST_NAME"])):
        schema = ", ".join(["DATAID string", "UN_LIST_TYPE string", "COMMENTS1 string", *[f"{n} string" for n in names], f"{tag}_ALIAS array<{one}>"])
        rows = spark.read.option("rowTag", tag).schema(schema).xml(path)
        name = F.array_join(_filled(F.array(*[F.trim(n) for n in names])), " ")
        aliases = _filled(F.transform(F.coalesce(F.col(f"{tag}_ALIAS"), F.array().cast(f"array<{one}>")), lambda a: F.trim(a["ALIAS_NAME"])))
        parts.append(rows.select(F.lit("UN-CONSOLIDATED").alias("list"), F.coalesce("DATAID", F.lit("")).alias("entry_id"), name.alias("name"), F.lit(tag.lower()).alias("type"), F.coalesce("UN_LIST_TYPE", F.lit("")).alias("program"), F.col("COMMENTS1").alias("remarks"), aliases.alias("aliases")))
    return parts[0].unionByName(parts[1])


def bis_json(raw: DataFrame) -> DataFrame:
    """``results`` of a saved response in a ``raw`` column."""
    shape = "results array<struct<id: string, name: string, source: string, remarks: string, programs: array<string>, alt_names: array<string>>>"
    rows = raw.select(F.explode(F.from_json("raw", shape)["results"]).alias("e")).filter("e is not null").select("e.*")
    empty = F.array().cast("array<string>")
    return rows.select(
        F.lit("BIS-CSL").alias("list"), F.coalesce("id", F.lit("")).alias("entry_id"), F.coalesce("name", F.lit("")).alias("name"), F.coalesce("source", F.lit("")).alias("type"),
        F.array_join(F.coalesce("programs", empty), "; ").alias("program"), "remarks", _filled(F.transform(F.coalesce("alt_names", empty), lambda a: F.trim(a))).alias("aliases"),
    )


def _cells(spark: SparkSession, path: str, sep: str, header: str | None) -> tuple[DataFrame, list[str]]:
    """(pos, cells) of the rows after the header and the header's names; preamble lines before it are skipped.

    The header is the first line that holds ``header``, else the first line.  Only the header line reaches the driver; the rows
    are read as records, so a quoted cell may hold separators and line ends.  Missing cells are ''.
    """
    lines = spark.read.text(path).select(F.monotonically_increasing_id().alias("pos"), F.regexp_replace("value", "^\ufeff", "").alias("value"))
    heads = lines.filter(F.col("value").contains(header)) if header else lines
    top = heads.orderBy("pos").limit(1).collect() or lines.orderBy("pos").limit(1).collect()
    if not top:
        return lines.filter("false").select("pos", F.array("value").alias("cells")), []
    names = next(csv.reader([top[0].value], delimiter=sep))
    read = spark.read.schema(", ".join(f"c{i} string" for i in range(len(names)))).csv(path, sep=sep, multiLine=True, quote='"', escape='"', encoding="UTF-8")
    rows = read.select(F.monotonically_increasing_id().alias("pos"), F.array(*[F.coalesce(c, F.lit("")) for c in read.columns]).alias("cells"))
    first = rows.filter(F.regexp_replace(F.array_join("cells", sep), "^\ufeff", "") == sep.join(names)).agg(F.min("pos").alias("first"))  # one row
    rows = rows.join(F.broadcast(first), F.col("pos") > F.col("first")).filter(F.array_join("cells", "") != "")
    return rows.select("pos", F.transform("cells", lambda c: F.trim(c)).alias("cells")), names


def _grouped(rows: DataFrame, listed: str) -> DataFrame:
    """Rows (pos, entry_id, name, primary, type, program) of one entry to its entry: type and programme of its first row, the first
    primary name (else the first name) leads, the others are aliases in order; an entry without any name has ''."""
    name = F.when(F.col("name") != "", F.struct((~F.col("primary")).alias("later"), "pos", "name"))
    out = rows.filter("entry_id <> ''").groupBy("entry_id").agg(F.min(F.struct("pos", "type", "program")).alias("top"), F.array_sort(F.collect_list(name)).alias("names"))
    others = F.array_sort(F.transform(F.slice("names", 2, F.greatest(F.size("names"), F.lit(1))), lambda n: F.struct(n["pos"], n["name"])))
    lead = F.coalesce(F.get("names", F.lit(0))["name"], F.lit(""))
    return out.select(F.lit(listed).alias("list"), "entry_id", lead.alias("name"), "top.type", "top.program", F.lit(None).cast("string").alias("remarks"), F.transform(others, lambda o: o["name"]).alias("aliases"))


def eu_csv(spark: SparkSession, path: str) -> DataFrame:
    """Semicolons; a repeated header counts at its first place; rows share ``Entity_logical_id``; no id or name column gives no entries."""
    rows, names = _cells(spark, path, ";", None)
    at = lambda *wanted: next((names.index(w) for w in wanted if w in names), None)
    key, name = at("Entity_logical_id"), at("Naal_wholename", "NameAlias_WholeName")
    if key is None or name is None:
        return spark.createDataFrame([], "list string, entry_id string, name string, type string, program string, remarks string, aliases array<string>")
    pick = lambda i: F.lit("") if i is None else F.col("cells")[i]
    shaped = rows.select("pos", pick(key).alias("entry_id"), pick(name).alias("name"), F.lit(True).alias("primary"), pick(at("Subject_type", "Entity_SubjectType")).alias("type"), pick(at("Programme", "Entity_Regulation_Programme", "Leba_programme")).alias("program"))
    return _grouped(shaped.filter("name <> ''"), "EU-CONSOLIDATED")


def uk_csv(spark: SparkSession, path: str) -> DataFrame:
    """Preamble before the header with ``Unique ID``; a row whose ``Name type`` says primary leads, else the first row does."""
    rows, names = _cells(spark, path, ",", "Unique ID")
    at = lambda *wanted: next((names.index(w) for w in wanted if w in names), None)
    pick = lambda i: F.lit("") if i is None else F.col("cells")[i]
    key = F.coalesce(F.nullif(pick(at("Unique ID")), F.lit("")), pick(at("OFSI Group ID")))
    kind = F.coalesce(F.nullif(pick(at("Type of entity")), F.lit("")), pick(at("Designation Type")))
    parts = [pick(at(f"Name {i}")) for i in range(1, 7)]
    shaped = rows.select("pos", key.alias("entry_id"), F.regexp_replace(F.array_join(_filled(F.array(*parts)), " "), r"(?U)\s+", " ").alias("name"), kind.alias("type"), pick(at("Regime Name")).alias("program"), F.lower(pick(at("Name type"))).contains("primary").alias("primary"))
    return _grouped(shaped, "UK-FCDO")
