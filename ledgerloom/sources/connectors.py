"""Records of registers and search services from saved responses (a ``raw`` text column), as nested projections.

Live fetching is an injected callable and off by default: ``fetch_rows`` turns URLs into ``raw`` rows.
"""

from __future__ import annotations

import base64
import ipaddress
import os
from collections.abc import Callable, Iterator
from urllib.parse import urlencode, urljoin, urlsplit

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ledgerloom.functions.names import join_parts


class Unavailable(RuntimeError):
    """A source or an optional library that can't be used."""


def _text(c: Column | str) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def _record(source: str, land: str, number: Column, name: Column, status: Column, address: Column) -> list[Column]:
    return [F.lit(source).alias("source"), F.lit(land).alias("jurisdiction"), number.alias("reg_number"), name.alias("name"), status.alias("status"), address.alias("address"), F.lit(None).cast("string").alias("url")]


def current_name(names: Column) -> Column:
    """The first name without an end date, else the first, else ''."""
    open_names = F.filter(names, lambda n: n["endDate"].isNull() | (n["endDate"] == ""))
    return F.coalesce(F.get(open_names, F.lit(0))["name"], F.get(names, F.lit(0))["name"], F.lit(""))


def brreg(raw: DataFrame) -> DataFrame:
    shape = "_embedded struct<enheter: array<struct<organisasjonsnummer: string, navn: string, konkurs: boolean, forretningsadresse: struct<adresse: array<string>, postnummer: string, poststed: string, land: string>>>>"
    rows = raw.select(F.explode(F.from_json("raw", shape)["_embedded"]["enheter"]).alias("e")).filter("e is not null")
    a = F.col("e.forretningsadresse")
    street = F.array_join(F.filter(a["adresse"], lambda x: x.isNotNull() & (x != "")), " ")
    address = join_parts(", ", street, join_parts(" ", a["postnummer"], a["poststed"]), a["land"])
    return rows.select(*_record("BRREG", "NO", _text("e.organisasjonsnummer"), _text("e.navn"), F.when(F.coalesce("e.konkurs", F.lit(False)), "bankrupt").otherwise("active"), address))


def ares(raw: DataFrame) -> DataFrame:
    rows = raw.select(F.from_json("raw", "ico string, obchodniJmeno string, sidlo struct<textovaAdresa: string>").alias("e")).filter("e.ico <> ''")
    return rows.select(*_record("ARES", "CZ", F.col("e.ico"), _text("e.obchodniJmeno"), F.lit(None).cast("string"), F.nullif("e.sidlo.textovaAdresa", F.lit(""))))


def prh(raw: DataFrame) -> DataFrame:
    shape = "companies array<struct<businessId: struct<value: string>, tradeRegisterStatus: string, names: array<struct<name: string, endDate: string>>>>"
    rows = raw.select(F.explode(F.from_json("raw", shape)["companies"]).alias("e")).filter("e is not null")
    return rows.select(*_record("PRH", "FI", _text("e.businessId.value"), current_name(F.col("e.names")), F.nullif("e.tradeRegisterStatus", F.lit("")), F.lit(None).cast("string")))


def ariregister(raw: DataFrame) -> DataFrame:
    shape = "data array<struct<reg_code: string, name: string, status: string, legal_address: string, zip_code: string, url: string>>"
    rows = raw.select(F.explode(F.from_json("raw", shape)["data"]).alias("e")).filter("e is not null")
    out = rows.select(*_record("ARIREGISTER", "EE", _text("e.reg_code"), _text("e.name"), F.nullif("e.status", F.lit("")), join_parts(", ", F.col("e.legal_address"), F.col("e.zip_code"))), F.nullif("e.url", F.lit("")).alias("link"))
    return out.withColumn("url", F.col("link")).drop("link")


def gleif(raw: DataFrame) -> DataFrame:
    shape = "data array<struct<attributes: struct<lei: string, entity: struct<legalName: struct<name: string>, legalAddress: struct<country: string>, status: string>>>>"
    rows = raw.select(F.explode(F.from_json("raw", shape)["data"]).alias("e")).filter("e is not null")
    e = "e.attributes.entity"
    return rows.select(_text("e.attributes.lei").alias("lei"), _text(f"{e}.legalName.name").alias("legal_name"), _text(f"{e}.legalAddress.country").alias("country"), _text(f"{e}.status").alias("status"))


def companies_house(raw: DataFrame) -> DataFrame:
    rows = raw.select(F.explode(F.from_json("raw", "items array<struct<company_number: string, title: string, company_status: string, address_snippet: string>>")["items"]).alias("e")).filter("e is not null")
    return rows.select(_text("e.company_number").alias("company_number"), _text("e.title").alias("title"), _text("e.company_status").alias("status"), _text("e.address_snippet").alias("address"))


def gdelt(raw: DataFrame) -> DataFrame:
    """A blank body holds no articles; a body that is not JSON raises, so that throttling is never taken for no news."""
    body = F.trim("raw")
    bad = (body != "") & F.try_parse_json(body).isNull()
    checked = raw.select(F.when(bad, F.raise_error(F.concat(F.lit("non-JSON body: "), F.substring(body, 1, 160)))).otherwise(body).alias("b"))
    fields = ["url", "title", "seendate", "domain", "language"]
    rows = checked.select(F.explode(F.from_json("b", "articles array<struct<" + ", ".join(f"{f}: string" for f in fields) + ">>")["articles"]).alias("e")).filter("e is not null")
    return rows.select(*[_text(f"e.{f}").alias(f) for f in fields])


def wikidata_search(raw: DataFrame) -> DataFrame:
    shown = "struct<label: struct<value: string>, description: struct<value: string>>"
    rows = raw.select(F.explode(F.from_json("raw", f"search array<struct<id: string, label: string, description: string, display: {shown}>>")["search"]).alias("e")).filter("e is not null")
    pick = lambda f: F.coalesce(F.nullif(f"e.{f}", F.lit("")), F.col(f"e.display.{f}.value"), F.lit(""))
    return rows.select(_text("e.id").alias("qid"), pick("label").alias("label"), pick("description").alias("description"))


#: Properties of interest and the fields they give, in order of output (fixed values).
PROPERTIES = {"P1278": "lei", "P856": "official_website", "P17": "country", "P452": "industry", "P749": "parent_organization", "P571": "inception", "P946": "isin", "P414": "stock_exchange", "P1320": "opencorporates_id", "P1454": "legal_form"}
_VALUE_PATHS = {"wikibase-entityid": "$.id", "time": "$.time", "quantity": "$.amount", "monolingualtext": "$.text"}


def wikidata_facts(raw: DataFrame) -> DataFrame:
    """(qid, facts map<field, array<string>>) of ``raw`` and ``qid`` columns; fields without a usable value are left out."""
    snak = "struct<mainsnak: struct<snaktype: string, datavalue: struct<type: string, value: string>>>"
    claims = F.from_json("raw", f"entities map<string, struct<claims: map<string, array<{snak}>>>>")["entities"]
    docs = raw.select("qid", F.try_element_at(claims, F.col("qid"))["claims"].alias("claims"))

    def value(s: Column) -> Column:
        d = s["mainsnak"]["datavalue"]
        out = F.when(d["type"] == "string", d["value"])
        for kind, path in _VALUE_PATHS.items():
            out = out.when(d["type"] == kind, F.get_json_object(d["value"], path))
        return F.when(s["mainsnak"]["snaktype"] == "value", out)

    fields = [F.struct(F.lit(f).alias("key"), F.array_compact(F.transform(F.try_element_at("claims", F.lit(p)), value)).alias("value")) for p, f in PROPERTIES.items()]
    facts = F.filter(F.array(*fields), lambda e: F.coalesce(F.size(e["value"]), F.lit(0)) > 0)
    return docs.select("qid", F.map_from_entries(facts).alias("facts"))


def edgar_filings(raw: DataFrame, forms: tuple[str, ...] = ("10-K", "10-Q", "20-F")) -> DataFrame:
    """(accession, form, filed, description) of a submissions document, whose columns are parallel arrays."""
    shape = "filings struct<recent: struct<accessionNumber: array<string>, form: array<string>, filingDate: array<string>, primaryDocDescription: array<string>>>"
    r = F.from_json("raw", shape)["filings"]["recent"]
    rows = raw.select(F.explode(F.arrays_zip(r["accessionNumber"].alias("accession"), r["form"].alias("form"), r["filingDate"].alias("filed"), r["primaryDocDescription"].alias("description"))).alias("f")).select("f.*")
    return rows.filter(F.col("form").isin(*forms))


PARSERS: dict[str, Callable[[DataFrame], DataFrame]] = {f.__name__: f for f in (brreg, ares, prh, ariregister, gleif, companies_house, gdelt, wikidata_search, edgar_filings)}


def basic_auth(key: str) -> str:
    return "Basic " + base64.b64encode(f"{key}:".encode()).decode()


def query_url(base: str, params: dict) -> str:
    """Lists repeat their key."""
    return f"{base}?{urlencode(params, doseq=True)}"


#: Hosts that serve machine metadata (fixed values).
METADATA_HOSTS = {"metadata.google.internal", "metadata", "169.254.169.254"}


def is_public(url: str, addresses: list[str]) -> bool:
    """http(s), a host that is no metadata host, and every resolved address is globally routable."""
    parts = urlsplit(url or "")
    host = (parts.hostname or "").lower().rstrip(".")
    if parts.scheme not in ("http", "https") or not host or host in METADATA_HOSTS or addresses is None or not len(addresses):
        return False
    try:
        found = [ipaddress.ip_address(a) for a in addresses]
    except ValueError:
        return False
    return all((m if (m := getattr(a, "ipv4_mapped", None)) else a).is_global and not a.is_multicast for a in found)


@F.pandas_udf(T.BooleanType())
def public_url(url: pd.Series, addresses: pd.Series) -> pd.Series:
    return pd.Series([is_public(u, a) for u, a in zip(url, addresses)])


#: How many redirects are followed, how many bytes a response may have, and the name given where none is (fixed values).
MOST_REDIRECTS, MOST_BYTES, AGENT = 5, 50 << 20, "ledgerloom/1.0 (contact: set LEDGERLOOM_USER_AGENT)"


def user_agent(given: str | None = None) -> str:
    """The given name, else that of the environment, else the default; blanks don't count."""
    return next(a.strip() for a in (given, os.environ.get("LEDGERLOOM_USER_AGENT"), AGENT) if a and a.strip())


def guarded_get(url: str, client: Callable[[str, dict], tuple[int, dict, bytes]], resolver: Callable[[str], list[str]], *, agent: str | None = None, most_bytes: int = MOST_BYTES) -> tuple[bytes, dict]:
    """(content, {status, content_type, final_url}) through an injected ``client`` (url, headers) -> (status, headers, content).

    The URL and every redirect target must be public; too many redirects and too large responses raise.
    """
    for _ in range(MOST_REDIRECTS + 1):
        try:
            addresses = resolver(urlsplit(url).hostname or "")
        except OSError:
            addresses = []
        if not is_public(url, addresses):
            raise Unavailable(f"not a public address: {url}")
        status, headers, content = client(url, {"User-Agent": user_agent(agent)})
        named = {k.lower(): v for k, v in headers.items()}
        if status not in (301, 302, 303, 307, 308) or not named.get("location"):
            if len(content) > most_bytes:
                raise Unavailable(f"more than {most_bytes} bytes: {url}")
            return content, {"status": status, "content_type": named.get("content-type"), "final_url": url}
        url = urljoin(url, named["location"])
    raise Unavailable(f"more than {MOST_REDIRECTS} redirects")


def fetch_rows(urls: DataFrame, fetcher: Callable[[str], bytes] | None = None) -> DataFrame:
    """(url, raw) of a frame of URLs through an injected fetcher; without one nothing is fetched."""
    if fetcher is None:
        raise Unavailable("no fetcher given: live fetching is off")

    def get(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame({"url": f.url, "raw": [fetcher(u).decode("utf-8") for u in f.url]})

    return urls.select("url").mapInPandas(get, "url string, raw string")


class SavedResponses(DataSource):
    """``spark.read.format("saved_responses").option("paths", "a.json,b.json")``: one row (path, raw) per saved response file."""

    @classmethod
    def name(cls) -> str:
        return "saved_responses"

    def schema(self) -> str:
        return "path string, raw string"

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _ResponseReader([p for p in self.options.get("paths", "").split(",") if p])


class _ResponseReader(DataSourceReader):
    def __init__(self, paths: list[str]) -> None:
        self.paths = paths

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(p) for p in self.paths] or [InputPartition(None)]

    def read(self, partition: InputPartition) -> Iterator[tuple[str, str]]:
        if partition.value is not None:
            with open(partition.value, encoding="utf-8") as f:
                yield partition.value, f.read()


#: Public lists and how long they may be kept (fixed values).
LISTS = {"OFAC-SDN": "indefinite", "EU-CONSOLIDATED": "per_license", "UK-FCDO": "indefinite", "BIS-CSL": "per_license", "UN-CONSOLIDATED": "session_only"}


def capabilities() -> dict[str, bool]:
    """Which optional libraries are there; never raises."""
    import importlib.util

    return {m: importlib.util.find_spec(m) is not None for m in ("bs4", "defusedxml", "httpx", "jsonschema", "pdfplumber", "duckdb", "pyarrow")}
