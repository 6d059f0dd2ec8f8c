from __future__ import annotations

import itertools
import math
import random

from conftest import rows
from pyspark.sql import functions as F

from ledgerloom.operators import shredding, units

SCHEMA = (
    "artifact_id string, company_id string, run_id string, source_id string, source_context struct<source_native_statement_name: string>, notes string, footnotes array<struct<text: string>>, "
    "periods array<struct<period_id: string, fiscal_year: long, currency_reported: string, unit_scale: string, restated: boolean>>, "
    "line_items array<struct<line_item_id: string, source_native_label: string, scope: string, column_ref: string, value_raw: string, value_numeric: double, cell_locator: map<string,string>, normalized_candidate: struct<taxonomy_key: string, confidence: double>>>, pos int"
)


def item(col="FY", value=1.0, key="revenue", raw=None, label="Revenue", scope="consolidated"):
    return ("li", label, scope, col, raw, value, {"row": "0"}, (key, 0.5))


def art(name, periods, items, company="A", notes=None, statement=None, footnotes=None):
    return (name, company, "20240101T", "s", (statement,), notes, footnotes, periods, items, 7)


def test_items_point_to_their_last_period(spark):
    p = ("FY", 2024, "USD", None, False)
    data = [art("a", [p, None, p, ("Q1", 2024, "USD", None, False)], [item(), None, item("nope"), item("Q1", key=None), item(None)]), art("a", [p], []), art("b", None, [item()]), art("c", [p], None)]
    data.append(data[0])
    tables = shredding.financial_tables(spark.createDataFrame(data, SCHEMA))
    got = tables["line_items"].filter("period_pos is not null").select("artifact_id", "pos", "period_pos").distinct()
    assert rows(got) == [("a", 0, 2), ("a", 3, 3)]
    assert tables["line_items"].filter("is_null").select("pos").distinct().collect()[0].pos == 1
    assert tables["periods"].filter("artifact_id = 'a'").select("row_key", "pos").distinct().count() == 5
    assert "src__pos" in tables["artifacts"].columns


def test_shared_and_repeated_elements_get_tables(spark):
    schema = "id int, left struct<at: struct<x: int, y: int>>, right struct<at: struct<x: int, y: int>>, tags array<string>, kv map<string,int>, one struct<a: int, b: struct<c: int>>"
    df = spark.createDataFrame([(1, ((1, 2),), ((3, 4),), ["p", None], {"k": 1}, (5, (6,))), (2, None, None, None, None, None)], schema)
    tables = shredding.shred(df, "t", ("id",))
    assert rows(tables["t"].select("id", "one__a", "one__b__c")) == [(1, 5, 6), (2, None, None)]
    assert rows(tables["left__at"].select("id", "x", "y")) == [(1, 1, 2)]
    assert rows(tables["right__at"].select("id", "x", "y")) == [(1, 3, 4)]
    assert rows(tables["tags"].select("id", "pos", "value", "is_null")) == [(1, 0, "p", False), (1, 1, None, True)]
    assert rows(tables["kv"].select("id", "map_key", "value")) == [(1, "k", 1)]


def test_units_in_text(spark):
    cases = {
        "kEUR": ("EUR", 1e3), "TUSD": ("USD", 1e3), "Mio. CHF": ("CHF", 1e6), "SKrm": ("SEK", 1e6), "złbn": ("PLN", 1e9), "GBX": ("GBP", 0.01), "GBp (pence)": ("GBP", 0.01), "₹ Cr.": ("INR", 1e7),
        "Rs. lakhs": ("INR", 1e5), "¥100m units": ("JPY", 1e8), "hundred million yen": ("JPY", 1e8), "GBP": ("GBP", None), "CZK '000": ("CZK", 1e3), "whole NOK": ("NOK", 1.0), "not stated": (None, None),
        "Alle Beträge in Tausend norwegischen Kronen.": ("NOK", 1e3), "En milliards de couronnes suédoises, sauf indication contraire.": ("SEK", 1e9), "Extracted from scan.": (None, None), "figures in thousands": (None, 1e3),
    }
    df = spark.createDataFrame([(t,) for t in cases], "t string")
    got = {r.t: (r.c, r.s) for r in df.select("t", units.unit_currency(F.col("t")).alias("c"), units.unit_scale(F.col("t")).alias("s")).collect()}
    assert got == cases


def test_narrower_statement_counts(spark):
    p = ("FY", 2024, "EUR", "millions", False)
    none = ("FY", 2024, "n/a", None, False)
    data = [
        art("a", [p], [item(raw="USD 5 thousand"), item(label="Revenue (kCHF)"), item(raw="5,0"), item(raw="£5", label="Revenue [kCHF]")]),
        art("b", [none], [item()], statement="Presented in thousands of NOK."),
        art("c", [("FY", 2024, "JPY", None, False)], [item()], notes="Figures in millions."),
        art("d", [none], [item()]),
    ]
    got = units.stated_values(spark.createDataFrame(data, SCHEMA)).select("artifact_id", "line_pos", F.transform("units", lambda u: F.concat_ws(" ", u["currency"], u["scale"].cast("int").cast("string"))).alias("u"))
    assert rows(got) == [("a", 0, ["USD 1000"]), ("a", 1, ["CHF 1000"]), ("a", 2, ["EUR 1000000"]), ("a", 3, ["GBP 1"]), ("b", 0, ["NOK 1000"]), ("c", 0, ["JPY 1000000"]), ("d", 0, [])]


def test_pairs_against_brute_force_and_resolution(spark):
    rng = random.Random(5)
    rates = {"USD": 1.0, "EUR": 1.1}
    data = []
    for i in range(30):
        currency, scale = rng.choice(["USD", "EUR"]), rng.choice([("ones", 1.0), ("thousands", 1e3)])
        usd = rng.choice([1000.0, 1003.0, 1010.0, -1000.0, 0.0, 500.0])
        data.append(art(f"a{i:02d}", [("FY", 2024, currency, scale[0], False)], [item(value=usd / rates[currency] / scale[1])]))
    fx = spark.createDataFrame([(c, 2024, r) for c, r in rates.items()], "currency_code string, fiscal_year long, usd_per_unit double")
    values = units.in_dollars(units.stated_values(spark.createDataFrame(data, SCHEMA)), fx)
    flat = [(r.artifact_id, r.usd, r.value_numeric) for r in values.collect()]
    agree = lambda x, y: abs(x - y) <= 0.005 * max(abs(x), abs(y))
    want = sorted((a[0], 0, b[0], 0) for a, b in itertools.product(flat, flat) if a[0] < b[0] and agree(a[1], b[1]) and not agree(a[2], b[2]))
    assert rows(units.agreeing_pairs(values)) == want and want
    # two texts contradict each other: the figure elsewhere decides
    twice = art("z1", [("FY", 2024, None, None, False)], [item(value=1.0)], notes="Presented in thousands of USD.", statement="Presented in millions of USD.", company="B")
    other = art("z2", [("FY", 2024, "USD", "ones", False)], [item(value=1000.0)], company="B")
    got = {r.artifact_id: (r.unit_status, r.usd) for r in units.in_dollars(units.stated_values(spark.createDataFrame([twice, other], SCHEMA)), fx).collect()}
    assert got["z1"][0] == "resolved" and math.isclose(got["z1"][1], 1000.0)
    alone = {r.artifact_id: r.unit_status for r in units.in_dollars(units.stated_values(spark.createDataFrame([twice], SCHEMA)), fx).collect()}
    assert alone == {"z1": "ambiguous"}


def test_empty(spark):
    fx = spark.createDataFrame([], "currency_code string, fiscal_year long, usd_per_unit double")
    assert units.agreeing_pairs(units.in_dollars(units.stated_values(spark.createDataFrame([], SCHEMA)), fx)).count() == 0


def test_stated_units_are_held_against_identities(spark):
    usd = lambda scale: [("FY", 2024, "USD", scale, False)]
    data = [
        art("a1", usd("ones"), [item(value=1000.0)]), art("a2", usd("thousands"), [item(value=1.01)]), art("a3", usd("millions"), [item(value=1.0)]),
        art("b1", usd("thousands"), [item(value=5.0)], company="B"), art("b2", usd("thousands"), [item(value=5.0)], company="B"), art("c", usd("ones"), [item(value=7.0)], company="C"), art("d", usd("ones"), [item(value=0.0)], company="D"),
    ]
    fx = spark.createDataFrame([("USD", 2024, 1.0)], "currency_code string, fiscal_year long, usd_per_unit double")
    values = units.in_dollars(units.stated_values(spark.createDataFrame(data, SCHEMA)), fx)
    got = {r.artifact_id: r for r in units.check_units(values).collect()}
    assert len(got) == len(data) and {r.unit_status for r in got.values()} == {"stated"}
    assert [got[a].contradicted for a in ("a3", "b1", "b2", "c", "d")] == [True, False, False, False, False]
    assert got["b1"].residual < 1e-9 and got["c"].residual is None and got["d"].residual is None
    rows_ = [("z", i, "Z", "r", "FY", 2024, "consolidated", k, v, [("USD", s)]) for i, (k, v, s) in enumerate([("total_assets", 9.0, 1e3), ("total_liabilities", 4.0, 1e3), ("equity", 5.0, 1e6), ("revenue", 3.0, 1.0)])]
    own = spark.createDataFrame(rows_, "artifact_id string, line_pos int, company_id string, run_id string, period_id string, fiscal_year long, scope string, taxonomy_key string, value_numeric double, units array<struct<currency: string, scale: double>>")
    flags = {r.taxonomy_key: r.contradicted for r in units.check_units(units.in_dollars(own, fx)).collect()}
    assert flags["equity"] and not flags["revenue"]


VALUES = "artifact_id string, line_pos int, company_id string, run_id string, period_id string, fiscal_year long, scope string, taxonomy_key string, value_numeric double, units array<struct<currency: string, scale: double>>"
FX = [("USD", 2024, 1.0), ("EUR", 2024, 1.1), ("JPY", 2024, 0.0064)]


def resolved(spark, figures):
    """figures: (artifact, figure, value, stated units); one company, run and period."""
    rows_ = [(a, i, "C", "r", "FY", 2024, "consolidated", k, v, u) for i, (a, k, v, u) in enumerate(figures)]
    got = units.in_dollars(spark.createDataFrame(rows_, VALUES), spark.createDataFrame(FX, "currency_code string, fiscal_year long, usd_per_unit double")).collect()
    assert len(got) == len(figures)
    return {(r.artifact_id, r.taxonomy_key): (r.unit_status, r.currency, r.scale) for r in got}


def test_units_that_were_removed_are_found_by_identities(spark):
    usd, none = [("USD", 1.0)], []
    got = resolved(spark, [
        ("a", "revenue", 5500.0, usd), ("a", "cost_of_sales", -2200.0, usd), ("a", "equity", 110.0, usd), ("b", "revenue", 5.01, none), ("b", "cost_of_sales", -1.99, none), ("b", "gross_profit", 3.0, none),
        # what b resolves to is evidence for c, which shares only the gross profit with it
        ("c", "gross_profit", 3300.0, none), ("d", "net_income", 7.0, none),
    ])
    assert [got["b", k] for k in ("revenue", "cost_of_sales", "gross_profit")] == [("resolved", "EUR", 1000.0)] * 3
    assert got["c", "gross_profit"] == ("resolved", "USD", 1.0) and got["d", "net_income"] == ("unknown", None, None)


def test_signs_and_ties_of_units(spark):
    usd, two = [("USD", 1.0)], [("USD", 1.0), ("USD", 1000.0)]
    # The column's items decide together: one of them alone would take the other unit.
    got = resolved(spark, [("a", "revenue", 1000.0, usd), ("a", "equity", 2000.0, usd), ("a", "capex", 60.0, usd), ("b", "revenue", 1.0, two), ("b", "equity", 2.0, two), ("b", "capex", 1.0, two)])
    assert {got["b", k] for k in ("revenue", "equity", "capex")} == {("resolved", "USD", 1000.0)}
    # 30 lies as far from one thousandth as from a thousand times: not unique.
    got = resolved(spark, [("a", "revenue", 1000.0, usd), ("b", "revenue", math.sqrt(1000.0), two)])
    assert got["b", "revenue"][0] == "ambiguous"
    rows_ = [("a", "revenue", 1000.0, usd), ("b", "revenue", -1.0, two)]
    flipped = spark.createDataFrame([(a, i, "C", "r", "FY", 2024, "consolidated", k, v, u) for i, (a, k, v, u) in enumerate(rows_)], VALUES)
    fx = spark.createDataFrame(FX, "currency_code string, fiscal_year long, usd_per_unit double")
    worst = {r.artifact_id: r.residual for r in units.in_dollars(flipped, fx).collect()}
    assert worst["b"] >= units.WRONG_SIGN
