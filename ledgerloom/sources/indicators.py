"""Observations of statistical services from saved JSON responses (a ``raw`` text column), decoded with expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.names import to_float

OBSERVATION = ["source", "series", "area", "period", "value", "label", "dims"]


def _observations(df: DataFrame) -> DataFrame:
    return df.select(*OBSERVATION)


def positions(flat: Column, sizes: Column) -> Column:
    """Position in each dimension of a flat row-major index; the last dimension varies fastest; a size of 0 gives 0."""
    one = F.lit(1).cast("long")

    def place(size: Column, i: Column) -> Column:
        stride = F.aggregate(F.slice(sizes, i + 2, F.size(sizes)), one, lambda a, x: a * x.cast("long"))
        return F.when((size == 0) | (stride == 0), F.lit(0).cast("long")).otherwise(F.pmod(F.call_function("div", flat, stride), size.cast("long")))

    return F.transform(sizes, lambda s, i: place(s, i))


def codes_at(key: Column, codes: Column) -> Column:
    """Codes of a colon-separated key of positions: '' outside a list; dimensions beyond the key are left out."""
    parts = F.split(key, ":")
    return F.transform(F.slice(codes, 1, F.least(F.size(codes), F.size(parts))), lambda c, i: F.coalesce(F.try_element_at(c, F.get(parts, i).try_cast("int") + 1), F.lit("")))


def bls(raw: DataFrame) -> DataFrame:
    """A response that did not succeed raises."""
    shape = "status string, message array<string>, Results struct<series: array<struct<seriesID: string, data: array<struct<year: string, period: string, periodName: string, value: string>>>>>"
    docs = raw.select(F.from_json("raw", shape).alias("d"))
    failed = (F.col("d.status") != "") & (F.col("d.status") != "REQUEST_SUCCEEDED")
    docs = docs.select(F.when(failed, F.raise_error(F.concat(F.lit("request not successful: "), F.col("d.status")))).otherwise(F.col("d.Results.series")).alias("series"))
    rows = docs.select(F.explode("series").alias("s")).select("s.seriesID", F.explode("s.data").alias("o")).filter("o is not null")
    period = F.concat_ws("-", F.coalesce("o.year", F.lit("")), F.coalesce("o.period", F.lit("")))
    return _observations(rows.select(F.lit("BLS").alias("source"), F.coalesce("seriesID", F.lit("")).alias("series"), F.lit(None).cast("string").alias("area"), period.alias("period"), to_float(F.col("o.value")).alias("value"), F.col("o.periodName").alias("label"), F.lit(None).cast("map<string,string>").alias("dims")))


def world_bank(raw: DataFrame) -> DataFrame:
    """The rows are the second element of the top-level array; null values stay."""
    row = "struct<indicator: struct<id: string, value: string>, country: struct<id: string, value: string>, countryiso3code: string, date: string, value: string>"
    second = F.get_json_object("raw", "$[1]")
    rows = raw.select(F.explode(F.from_json(second, f"array<{row}>")).alias("o")).filter("o is not null")
    area = F.coalesce(F.nullif("o.countryiso3code", F.lit("")), F.col("o.country.id"))
    return _observations(rows.select(F.lit("WORLD_BANK").alias("source"), F.coalesce("o.indicator.id", F.lit("")).alias("series"), area.alias("area"), F.col("o.date").alias("period"), to_float(F.col("o.value")).alias("value"), F.col("o.indicator.value").alias("label"), F.lit(None).cast("map<string,string>").alias("dims")))


def eurostat(raw: DataFrame) -> DataFrame:
    """JSON-stat 2.0: a sparse map from flat index to value over named dimensions."""
    shape = "label string, id array<string>, size array<long>, value map<string,string>, dimension map<string, struct<category: struct<index: map<string,long>>>>"
    docs = raw.select(F.from_json("raw", shape).alias("d")).select("d.*").filter("size(value) > 0 and size(id) = size(size) and size(size) > 0")
    each = docs.select("label", "id", "size", "dimension", F.explode("value").alias("k", "v")).withColumn("flat", F.col("k").try_cast("long")).filter("flat is not null")
    at = positions(F.col("flat"), F.col("size"))

    def code(name: Column, i: Column) -> Column:
        index = F.map_entries(F.try_element_at(F.col("dimension"), name)["category"]["index"])
        hit = F.filter(index, lambda e: e["value"] == F.get(F.col("at"), i))
        return F.coalesce(F.get(hit, F.lit(0))["key"], F.lit(""))

    rows = each.withColumn("at", at).withColumn("dims", F.map_from_arrays("id", F.transform("id", lambda n, i: code(n, i))))
    pick = lambda n: F.try_element_at("dims", F.lit(n))
    return _observations(rows.select(F.lit("EUROSTAT").alias("source"), F.coalesce(pick("na_item"), F.lit("")).alias("series"), pick("geo").alias("area"), pick("time").alias("period"), to_float(F.col("v")).alias("value"), F.coalesce("label", F.lit("")).alias("label"), "dims"))


def oecd(raw: DataFrame) -> DataFrame:
    """SDMX-JSON with all dimensions at the observation."""
    shape = "data struct<structures: array<struct<name: string, dimensions: struct<observation: array<struct<id: string, values: array<struct<id: string>>>>>>>, dataSets: array<struct<observations: map<string, array<string>>>>>"
    docs = raw.select(F.from_json("raw", shape).alias("d")).select(F.get("d.data.structures", F.lit(0)).alias("s"), F.get("d.data.dataSets", F.lit(0)).alias("x")).filter("s is not null and x is not null")
    rows = docs.select("s", F.explode("x.observations").alias("key", "arr"))
    dims = F.col("s.dimensions.observation")
    codes = codes_at(F.col("key"), F.transform(dims, lambda d: F.transform(d["values"], lambda v: F.coalesce(v["id"], F.lit("")))))
    rows = rows.withColumn("codes", codes).withColumn("dims", F.map_from_arrays(F.slice(F.transform(dims, lambda d: d["id"]), F.lit(1), F.size("codes")), F.col("codes")))
    pick = lambda n: F.try_element_at("dims", F.lit(n))
    return _observations(rows.select(F.lit("OECD").alias("source"), F.coalesce(pick("MEASURE"), F.lit("")).alias("series"), pick("REF_AREA").alias("area"), pick("TIME_PERIOD").alias("period"), to_float(F.get("arr", F.lit(0))).alias("value"), F.coalesce("s.name", F.lit("")).alias("label"), "dims"))
