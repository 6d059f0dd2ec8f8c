"""Quantities recorded in different units, brought to US dollars in ones.

A value's unit is a pair (currency, scale).  ``read_unit`` reads it from one statement; the statement nearest the
value counts: its cell, its row, its column (period), the texts of its record.  The nearest level's readings are the item's
candidates; where nothing is stated, every currency of the rates in every scale is one.  Identities among columns decide:

* value in dollars = stated value * scale * rate, so the same figure in another record must give the same dollars;
* the sum identities of ``IDENTITIES`` within one record and period.

Items of one column (record and period) with the same candidates are in one unit, so a column's candidate is chosen for all of them at
once: the one with the smallest sum of squared log residuals over all identities of all its items, a wrong sign counting as a power of
ten.  Columns that are decided are evidence for the others in the next of ``ROUNDS`` rounds.  The text is a prior that leaves the
other units out, so a single reading stands and the identities can only contradict it.  ``unit_status`` is ``stated`` (one reading),
``resolved`` (the identities single one out), ``ambiguous`` (no other value to compare with, or the two best candidates are closer than
``MARGIN``) or ``unknown`` (no statement and no evidence).  ``check_units`` flags stated units that contradict the identities.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.operators.shredding import financial_tables
from ledgerloom.session import materialise

#: How each currency is written (fixed values): ISO code, then its signs and its names in English, German and French.
CURRENCIES = {
    "USD": ["US$", "US dollar", "US-dollar", "U.S. dollar", "United States dollar", "dollar américain", "dollars américains"],
    "EUR": ["€", "euro"],
    "GBP": ["GBX", "GBp", "£", "pound sterling", "pounds sterling", "British pound", "Pfund Sterling", "livre sterling", "livres sterling", "pence"],
    "JPY": ["¥", "yen", "Japanese yen", "yen japonais", "yens japonais", "japanischen Yen"],
    "INR": ["₹", "Rs.", "Rs", "rupee", "Indian rupee", "indischen Rupien", "indische Rupien", "roupie indienne", "roupies indiennes"],
    "PLN": ["zł", "zloty", "Polish zloty", "polnischen Zloty", "zloty polonais", "zlotys polonais"],
    "CZK": ["Kč", "Czech koruna", "Czech crown", "tschechischen Kronen", "tschechische Kronen", "couronnes tchèques"],
    "SEK": ["SKr", "Swedish kronor", "Swedish krona", "Swedish crown", "schwedischen Kronen", "schwedische Kronen", "couronnes suédoises"],
    "NOK": ["NKr", "Norwegian kroner", "Norwegian krone", "Norwegian crown", "norwegischen Kronen", "norwegische Kronen", "couronnes norvégiennes"],
    "CHF": ["SFr.", "SFr", "Swiss franc", "Schweizer Franken", "francs suisses", "franc suisse"],
}
#: How each scale is written (fixed values), as words of their own.
SCALES = {
    1e9: ["billion", "bn", "mrd", "milliarde", "milliarden", "milliard"], 1e8: ["hundred million", "100 million", "100m", "100 m"], 1e7: ["crore", "cr"], 1e6: ["million", "mn", "m", "mio", "millionen"],
    1e5: ["lakh", "lac"], 1e3: ["thousand", "'000", "tsd", "tausend", "millier", "k"], 1.0: ["whole"], 1e-2: ["pence", "gbx"],
}
SCALE_WORDS = {"ones": 1.0, "thousands": 1e3, "millions": 1e6, "billions": 1e9}
#: Sum identities among figures of one record and period: total = sum of parts; expenses are reported below zero.
IDENTITIES = [("gross_profit", ("revenue", "cost_of_sales")), ("total_assets", ("total_liabilities", "equity"))]

TOLERANCE = 0.005
#: Two readings whose residuals differ by less (a factor of about 1.05) can't be told apart.
MARGIN = 0.05
#: Scales are powers of ten: from half a power on, another scale is nearer.
OTHER_SCALE = math.log(10) / 2
#: What a wrong sign adds to the squared log residuals.
WRONG_SIGN = math.log(10) ** 2
#: Rounds in which decided columns are evidence for the others.
ROUNDS = 2
_BAND = -math.log(1 - TOLERANCE)


def _pattern(words: Sequence[str]) -> str:
    return "|".join(re.escape(w) for w in sorted(words, key=len, reverse=True))


_MONEY = {w.lower(): code for code, names in CURRENCIES.items() for w in [code, *names]}
_SCALE = {w: factor for factor, names in SCALES.items() for w in names}
#: A currency, perhaps with a scale letter glued to it (kEUR, TEUR, EURm, £k, złbn), not inside another word.
_MONEY_RX = rf"(?i)(?<![\p{{L}}])[kT]?({_pattern(list(_MONEY))})s?(?:k|mn?|bn)?(?![\p{{L}}])"
_GLUED_RX = rf"(?i)(?<![\p{{L}}])(?:(?-i:([kT]))(?:{'|'.join(CURRENCIES)})|(?:{_pattern(list(_MONEY))})(k|mn?|bn))(?![\p{{L}}])"
_SCALE_RX = rf"(?iU)(?<![\p{{L}}\d])({_pattern(list(_SCALE))})(?:s|\.)?(?![\p{{L}}])"


def _lookup(table: dict, found: Column) -> Column:
    entries = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
    return F.try_element_at(entries, F.lower(found))


def unit_currency(text: Column) -> Column:
    """ISO code of the currency that a text states first, else null."""
    return _lookup(_MONEY, F.regexp_extract(text, _MONEY_RX, 1))


def unit_scale(text: Column) -> Column:
    """The scale that a text states, else null; a word of its own counts before a letter glued to a currency."""
    plain = F.regexp_replace(text, "’", "'")
    pence = F.when(plain.rlike(r"\bGBp\b"), F.lit(1e-2))
    glued = F.concat(F.regexp_extract(plain, _GLUED_RX, 1), F.regexp_extract(plain, _GLUED_RX, 2))
    letters = {"k": 1e3, "t": 1e3, "m": 1e6, "mn": 1e6, "bn": 1e9}
    return F.coalesce(_lookup(_SCALE, F.regexp_extract(plain, _SCALE_RX, 1)), pence, _lookup(letters, glued))


def read_unit(text: Column) -> Column:
    """struct(currency, scale) of a statement; both null where it states neither."""
    # Most cells and labels state nothing: they are not searched.
    return F.when(F.length(F.trim(text)) > 0, F.struct(unit_currency(text).alias("currency"), unit_scale(text).alias("scale")))


def cell_unit_text(raw: Column) -> Column:
    """What is left of a cell without its number."""
    marked = F.regexp_replace(raw, r"['’]000", " thousand ")
    return F.regexp_replace(marked, r"[-+(]*\d[\d.,'’\s\u00a0\u202f]*\)?", " ")


def row_unit_text(label: Column) -> Column:
    """The bracket at the end of a row's label, where a unit may stand."""
    return F.nullif(F.regexp_extract(label, r"[(\[]([^()\[\]]+)[)\]]\s*$", 1), F.lit(""))


def nearest_units(levels: Sequence[Column]) -> Column:
    """Candidate units from arrays of readings, nearest level first.

    The nearest level with a currency counts, with its scale; if it has no scale, the scale that a level further out
    states *without* a currency holds (a note such as "figures in thousands"), else ones.
    """
    stated = [F.filter(level, lambda u: u["currency"].isNotNull()) for level in levels]
    bare = [F.filter(level, lambda u: u["currency"].isNull() & u["scale"].isNotNull()) for level in levels]
    out = F.array().cast("array<struct<currency:string,scale:double>>")
    for i in reversed(range(len(levels))):
        loose = F.coalesce(*[F.try_element_at(b, F.lit(1))["scale"] for b in bare[i:]], F.lit(1.0))
        units = F.array_distinct(F.transform(stated[i], _scaled(loose)))
        out = F.when(F.size(stated[i]) > 0, units).otherwise(out)
    return out


def _scaled(default: Column) -> Callable[[Column], Column]:
    return lambda u: F.struct(u["currency"].alias("currency"), F.coalesce(u["scale"], default).alias("scale"))


def stated_values(artifacts: DataFrame) -> DataFrame:
    """Line items with a numeric value, a taxonomy key and a period, each with its candidate units."""
    periods = F.transform("periods", lambda p: F.struct(
        p["period_id"].alias("period_id"), p["fiscal_year"].alias("fiscal_year"),
        F.struct(unit_currency(p["currency_reported"]).alias("currency"), F.coalesce(unit_scale(p["currency_reported"]), _scale_word(p["unit_scale"])).alias("scale")).alias("unit"),
    ))
    texts = F.array_append(F.array_append(F.coalesce(F.transform("footnotes", lambda f: f["text"]), F.array().cast("array<string>")), F.col("notes")), F.col("source_context.source_native_statement_name"))
    wide = artifacts.withColumns({"_periods": periods, "_texts": F.filter(F.transform(F.filter(texts, lambda t: t.isNotNull()), read_unit), lambda u: u["currency"].isNotNull() | u["scale"].isNotNull())})
    items = financial_tables(wide, ("artifact_id", "company_id", "run_id", "_periods", "_texts"))["line_items"]
    key = "normalized_candidate__taxonomy_key"
    items = items.filter(F.col(key).isNotNull() & F.col("period_pos").isNotNull() & F.col("value_numeric").isNotNull() & ~F.isnan("value_numeric"))
    period = F.element_at("_periods", F.col("period_pos") + 1)
    items = items.select(
        "artifact_id", F.col("pos").alias("line_pos"), "company_id", "run_id", period["period_id"].alias("period_id"), period["fiscal_year"].alias("fiscal_year"), "scope", F.col(key).alias("taxonomy_key"), "value_numeric",
        F.array(read_unit(cell_unit_text(F.col("value_raw")))).alias("_cell"), F.array(read_unit(row_unit_text(F.col("source_native_label")))).alias("_row"), F.array(period["unit"]).alias("_column"), "_texts",
    )
    units = nearest_units([F.col(c) for c in ("_cell", "_row", "_column", "_texts")])
    return items.withColumn("units", units).drop("_cell", "_row", "_column", "_texts").distinct()


def _scale_word(scale: Column) -> Column:
    out = F.lit(None).cast("double")
    for word, factor in SCALE_WORDS.items():
        out = F.when(F.lower(F.trim(scale)) == word, F.lit(factor)).otherwise(out)
    return out


def in_dollars(values: DataFrame, rates: DataFrame) -> DataFrame:
    """``values`` with ``currency, scale, usd, unit_status, residual``, one row per item.

    ``rates`` (currency_code, fiscal_year, usd_per_unit) is a small fixed table.  Items without exactly one candidate are
    few; only they and the figures they can be compared with take part in the joins of the resolution.
    """
    values = materialise(values, "stated")  # the parsing plan would be repeated in every branch below
    rate = F.broadcast(rates.groupBy(F.col("currency_code").alias("currency"), "fiscal_year").agg(F.max("usd_per_unit").alias("rate")))

    def priced(rows: DataFrame) -> DataFrame:
        rows = rows.withColumn("currency", F.col("unit.currency")).withColumn("scale", F.col("unit.scale")).drop("unit", "units")
        return rows.join(rate, ["currency", "fiscal_year"], "left").withColumn("usd", F.col("value_numeric") * F.col("scale") * F.col("rate")).drop("rate")

    single = priced(values.filter("size(units) = 1").withColumn("unit", F.element_at("units", 1)))
    single = single.withColumns({"unit_status": F.lit("stated"), "residual": F.lit(None).cast("double")})
    several = values.filter("size(units) <> 1").withColumn("units", F.array_sort("units"))
    if several.isEmpty():
        return single
    # Nothing stated: every unit of the year's rates (a small fixed table) may be meant.
    scales = F.array(*[F.lit(x) for x in sorted(SCALE_WORDS.values())])
    every = rates.groupBy("fiscal_year").agg(F.array_sort(F.collect_set("currency_code")).alias("codes"))
    every = every.select("fiscal_year", F.flatten(F.transform("codes", lambda c: F.transform(scales, lambda x: F.struct(c.alias("currency"), x.alias("scale"))))).alias("all_units"))
    several = several.join(F.broadcast(every), "fiscal_year", "left").withColumn("said", F.size("units") > 1)
    several = several.withColumn("unit", F.explode_outer(F.when(F.col("said"), F.col("units")).otherwise(F.col("all_units")))).withColumn("choice", F.md5(F.to_json("units"))).drop("all_units")
    return single.unionByName(resolve_units(priced(several), single))


FIGURE = ["company_id", "run_id", "period_id", "scope", "taxonomy_key"]


def _evidence(known: DataFrame, usd: str = "usd") -> DataFrame:
    """(FIGURE, artifact_id, size, sign): what the known values say of figures: of any record (null artifact) by the same figure, of their
    own record by its sum identities."""
    live = known.filter(F.col(usd) != 0)
    # The same figure elsewhere: its mean log size and sign stand for the group, so a group of any size is one row.
    same = live.groupBy(*FIGURE).agg(F.avg(F.log(F.abs(usd))).alias("size"), F.signum(F.sum(F.signum(usd))).alias("sign"))
    own = implied_by_identities(live)
    return same.withColumn("artifact_id", F.lit(None).cast("string")).unionByName(own)


def resolve_units(several: DataFrame, known: DataFrame) -> DataFrame:
    """The items of ``several`` (one row per item and candidate) with the candidate that fits their whole column best."""
    item = ["artifact_id", "line_pos"]
    column = ["artifact_id", "company_id", "run_id", "period_id", "choice"]
    # Items that are no different in unit but in value stand for each other only through their column.
    open_items = materialise(several.withColumn("size", F.log(F.nullif(F.abs("usd"), F.lit(0.0)))), "open")
    fields, evidence, done = open_items.columns, known.select("artifact_id", *FIGURE, "usd"), []
    for _ in range(ROUNDS):
        said = _evidence(evidence).withColumnsRenamed({"size": "implied", "artifact_id": "of"})
        met = open_items.join(said, FIGURE, "left").filter("of is null or of = artifact_id")
        cost = F.pow(F.col("size") - F.col("implied"), 2) + F.when((F.col("sign") != 0) & (F.signum("usd") != F.col("sign")), WRONG_SIGN).otherwise(0.0)
        fit = met.groupBy(*column, "currency", "scale").agg(F.sum(cost).alias("cost"), F.count(cost).alias("n"))
        ranked = fit.groupBy(*column).agg(F.array_sort(F.collect_list(F.when(F.col("n") > 0, F.struct("cost", "n", "currency", "scale")))).alias("r"))  # as many as candidates
        gap = F.sqrt(F.get("r", F.lit(1))["cost"] / F.get("r", F.lit(1))["n"]) - F.sqrt(F.get("r", F.lit(0))["cost"] / F.get("r", F.lit(0))["n"])
        decided = ranked.select(*column, F.get("r", F.lit(0)).alias("best"), F.coalesce((F.size("r") == 1) | (gap >= MARGIN), F.lit(False)).alias("unique"))
        out = materialise(open_items.join(decided, column, "left").withColumn("chosen", F.col("best.currency").eqNullSafe(F.col("currency")) & F.col("best.scale").eqNullSafe(F.col("scale"))), "resolved")
        # Only columns that are still open are fitted again, so none is evidence for itself.
        done.append(out.filter("unique"))
        evidence = evidence.unionByName(out.filter("chosen and unique").select("artifact_id", *FIGURE, "usd"))
        open_items = out.filter("not coalesce(unique, false)").select(*fields)
    out = reduce(DataFrame.unionByName, [*done, out.filter("not coalesce(unique, false)")])
    # One row per item: its chosen candidate, or the first one where there is no evidence.
    order = F.struct(~F.col("chosen"), "currency", "scale")
    best = out.groupBy(*item).agg(F.min_by(F.struct(*[F.col(c) for c in out.columns if c not in item]), order).alias("b")).select(*item, "b.*")
    status = F.when(F.col("chosen") & F.col("unique"), "resolved").when(F.col("chosen") | F.col("said"), "ambiguous").otherwise("unknown")
    best = best.withColumn("unit_status", status).withColumn("residual", F.col("best.cost") / F.col("best.n"))
    for c in ("currency", "scale", "usd"):
        best = best.withColumn(c, F.when(F.col("unit_status") != "unknown", F.col(c)))
    return best.select(*known.columns)


def implied_by_identities(live: DataFrame) -> DataFrame:
    """(FIGURE, artifact_id, size, sign): log size and sign of a figure by the other figures of its record and period; each of
    ``IDENTITIES`` (total = sum of parts) is solved for each of its figures."""
    block = ["artifact_id", "company_id", "run_id", "period_id", "scope"]
    figures = live.groupBy(*block, "taxonomy_key").agg(F.avg("usd").alias("usd"))
    found = []
    for total, parts in IDENTITIES:
        names = [total, *parts]
        wide = figures.filter(F.col("taxonomy_key").isin(*names)).groupBy(*block).agg(*[F.max(F.when(F.col("taxonomy_key") == n, F.col("usd"))).alias(n) for n in names])
        solved = {total: sum((F.col(p) for p in parts[1:]), F.col(parts[0]))}
        for p in parts:
            solved[p] = F.col(total) - sum((F.col(q) for q in parts if q != p), F.lit(0.0))
        found += [wide.select(*block, F.lit(name).alias("taxonomy_key"), F.log(F.nullif(F.abs(value), F.lit(0.0))).alias("size"), F.signum(value).alias("sign")).dropna(subset=["size"]) for name, value in solved.items()]
    return reduce(DataFrame.unionByName, found)


def check_units(values: DataFrame) -> DataFrame:
    """``values`` with the ``residual`` of stated units too, and whether it is so large that a unit of another scale fits
    better (``contradicted``).

    A stated unit is a combination of one candidate: it is held against the same figure elsewhere (its mean log size without
    the item itself) and the identities of its record.  It stays as stated, since figures also differ for other reasons.
    An item without any other value to compare with, or of zero dollars, has no residual and is not contradicted.
    """
    figure, block = FIGURE, ["artifact_id", *FIGURE]
    live = values.filter(F.col("unit_status").isin("stated", "resolved") & (F.col("usd") != 0))
    size = F.log(F.abs("usd"))
    same = live.groupBy(*figure).agg(F.sum(size).alias("_sum"), F.count("*").alias("_n"))
    identities = implied_by_identities(live).groupBy(*block).agg(F.sum("size").alias("_isum"), F.count("*").alias("_in"))
    near = values.join(same, figure, "left").join(identities, block, "left")
    other = F.when(F.col("_n") > 1, (F.col("_sum") - size) / (F.col("_n") - 1))
    implied = (F.coalesce(other, F.lit(0.0)) + F.coalesce("_isum", F.lit(0.0))) / F.nullif(other.isNotNull().cast("int") + F.coalesce("_in", F.lit(0)), F.lit(0))
    residual = F.when(F.col("unit_status") == "stated", F.pow(size - implied, 2)).otherwise(F.col("residual"))
    return near.withColumn("residual", residual).withColumn("contradicted", F.coalesce(F.sqrt("residual") > OTHER_SCALE, F.lit(False))).select(*values.columns, "contradicted")


def agreeing_pairs(values: DataFrame) -> DataFrame:
    """Pairs of items of two artifacts for one figure whose dollars agree while their stated numbers do not.

    A band join: values lie in bands of ``TOLERANCE`` on the log scale and only neighbouring bands meet.  Items with
    the same number and dollars form one class; classes are joined, then expanded, so copies cost nothing before
    the result.  Items without a usable unit take no part.
    """
    figure = FIGURE
    usable = values.filter(F.col("unit_status").isin("stated", "resolved") & F.col("usd").isNotNull()).dropna(subset=[*figure, "artifact_id"])
    # A figure is told by a 128-bit hash of its five fields, so that the shuffles below carry 16 bytes instead.
    named = F.unhex(F.md5(F.concat_ws("\u001f", *figure))).alias("figure")
    usable = materialise(usable.select(named, "usd", "value_numeric", "artifact_id", "line_pos"), "values")
    usable = usable.withColumns({"side": F.signum("usd").cast("tinyint"), "band": F.coalesce(F.when(F.col("usd") != 0, F.floor(F.log(F.abs("usd")) / _BAND)), F.lit(0)).cast("int")})
    classes = usable.select("figure", "side", "band", "usd", "value_numeric").distinct()
    left = classes.select("figure", "side", F.col("usd").alias("usd_a"), F.col("value_numeric").alias("num_a"), F.explode(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1)).alias("band"))
    right = classes.select("figure", "side", "band", F.col("usd").alias("usd_b"), F.col("value_numeric").alias("num_b"))
    pairs = left.join(right, ["figure", "side", "band"]).filter(_agree("usd_a", "usd_b") & ~_agree("num_a", "num_b")).drop("band", "side")
    members = usable.select("figure", "usd", "value_numeric", "artifact_id", "line_pos")
    for x in ("a", "b"):
        renamed = members.withColumnsRenamed({"usd": f"usd_{x}", "value_numeric": f"num_{x}", "artifact_id": f"artifact_{x}", "line_pos": f"line_pos_{x}"})
        pairs = pairs.join(renamed, ["figure", f"usd_{x}", f"num_{x}"])
    return pairs.filter("artifact_a < artifact_b").select("artifact_a", "line_pos_a", "artifact_b", "line_pos_b").distinct()


def _agree(a: str, b: str) -> Column:
    return F.abs(F.col(a) - F.col(b)) <= TOLERANCE * F.greatest(F.abs(a), F.abs(b))
