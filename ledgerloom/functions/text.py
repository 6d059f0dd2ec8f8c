"""Canonical text of raw content by media type, its hashes, and the class of a change between two versions."""

from __future__ import annotations

import json
import re
import unicodedata
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Keys of JSON documents that change with every retrieval (fixed values, lower case).
VOLATILE_KEYS = {"timestamp", "requestid", "csrf", "session", "nonce", "_ts"}
PROFILE_VERSION = "1"


#: Whitespace of any script, and the four information separators.
_BLANK = r"[\s\x1c-\x1f]"
#: Elements whose text is not shown (fixed values).
HIDDEN = {"script", "style"}


def squeeze(text: Column) -> Column:
    """Whitespace of any script to one blank, trimmed."""
    return F.trim(F.regexp_replace(text, f"(?U){_BLANK}+", " "))


def _ascii(text: Column) -> Column:
    return F.octet_length(text) == F.length(text)


@F.pandas_udf(T.StringType())
def compatible(text: pd.Series) -> pd.Series:
    """Compatibility composition (NFKC)."""
    return text.map(lambda t: unicodedata.normalize("NFKC", t) if isinstance(t, str) else None)


def normal_text(text: Column) -> Column:
    """Compatibility composition and squeezed whitespace; only text beyond ASCII leaves the JVM."""
    return squeeze(F.coalesce(compatible(F.when(~_ascii(text), text)), text))


def canonical_text(text: Column) -> Column:
    """Plain text: hyphenated line ends joined, form feeds as line ends, lines of a bare number between two others dropped."""
    joined = F.translate(F.replace(text, F.lit("-\n"), F.lit("")), "\f", "\n")
    return normal_text(F.regexp_replace(joined, rf"(?U)\n{_BLANK}*\d+{_BLANK}*\n", "\n"))


def canonical_html(text: Column) -> Column:
    """Text of HTML outside script and style, pieces joined by blanks; only texts with markup or references are parsed."""
    marked = text.contains("<") | text.contains("&")
    return normal_text(F.coalesce(visible_text(F.when(marked, text)), text))


def markup_events(source: str) -> list[tuple[int, str]]:
    """(1, name) an element opens, (-1, name) it closes, (0, text) what stands between, in order."""
    events: list[tuple[int, str]] = []
    tokenizer = HTMLParser(convert_charrefs=True)
    tokenizer.handle_starttag = lambda name, attributes: events.append((1, name))
    tokenizer.handle_endtag = lambda name: events.append((-1, name))
    tokenizer.handle_data = lambda data: events.append((0, data))
    tokenizer.feed(source)
    return events


def shown(source: str) -> str:
    """The pieces of text outside hidden elements, joined by blanks."""
    depth, pieces = 0, []
    for step, value in markup_events(source):
        if step and value in HIDDEN:
            depth = max(0, depth + step)
        elif not step and not depth:
            pieces.append(value)
    return " ".join(pieces)


@F.pandas_udf(T.StringType())
def visible_text(text: pd.Series) -> pd.Series:
    return text.map(lambda t: shown(t) if isinstance(t, str) else None)


def json_text(source: str) -> str:
    """JSON without volatile keys, keys sorted, compact, ASCII."""
    top = [json.loads(source)]
    todo: list[object] = [top]
    while todo:
        node = todo.pop()
        if isinstance(node, dict):
            for key in [k for k in node if k.lower() in VOLATILE_KEYS]:
                del node[key]
        todo += [x for x in (node.values() if isinstance(node, dict) else node) if isinstance(x, dict | list)]
    return json.dumps(top[0], sort_keys=True, separators=(",", ":"))


@F.pandas_udf(T.StringType())
def canonical_json(text: pd.Series) -> pd.Series:
    return text.map(lambda t: json_text(t) if isinstance(t, str) else None)


def profile_of(mime: Column) -> Column:
    """html, json or text for a media type, parameters and case aside."""
    kind = F.lower(F.trim(F.split_part(mime, F.lit(";"), F.lit(1))))
    return F.when(kind.isin("text/html", "application/xhtml+xml"), "html").when(kind.isin("application/json", "text/json"), "json").otherwise("text")


def canonical(text: Column, mime: Column) -> Column:
    """Canonical text by media type; each form is computed for its own rows only.  Text that is no JSON raises under a JSON type."""
    kind = profile_of(mime)
    forms = {"html": canonical_html, "json": canonical_json, "text": canonical_text}
    return F.coalesce(*[form(F.when(kind == name, text)) for name, form in forms.items()])


def content_hashes(raw: Column, mime: Column) -> Column:
    """struct(raw_hash, canonical_hash, profile_id, profile_version)."""
    return hash_pair(raw, canonical(raw, mime), mime)


def hash_pair(raw: Column, canonical: Column, mime: Column) -> Column:
    """``content_hashes`` of a canonical text that is known already."""
    return F.struct(F.sha2(raw, 256).alias("raw_hash"), F.sha2(canonical, 256).alias("canonical_hash"), profile_of(mime).alias("profile_id"), F.lit(PROFILE_VERSION).alias("profile_version"))


def diff_class(old: Column, new: Column) -> Column:
    """unavailable, unchanged, cosmetic_change or content_change between two hash structs."""
    return F.when(new.isNull(), "unavailable").when(old["raw_hash"] == new["raw_hash"], "unchanged").when(old["canonical_hash"] == new["canonical_hash"], "cosmetic_change").otherwise("content_change")


def tables_of(source: str) -> list[list[list[str]]]:
    """Tables of an HTML document: rows of stripped cells; empty rows and tables are left out, inner tables listed too."""
    found: list[list[list[str]]] = []
    open_tables: list[list[list[str]]] = []
    cells: list[list[str]] = []

    class Reader(HTMLParser):
        def handle_starttag(self, tag: str, attrs: object) -> None:
            if tag == "table":
                open_tables.append([])
                found.append(open_tables[-1])
            elif tag == "tr" and open_tables:
                open_tables[-1].append([])
            elif tag in ("td", "th") and open_tables:
                if not open_tables[-1]:
                    open_tables[-1].append([])
                cells.append([])

        def handle_endtag(self, tag: str) -> None:
            if tag in ("td", "th") and cells and open_tables and open_tables[-1]:
                open_tables[-1][-1].append(" ".join("".join(cells.pop()).split()))
            elif tag == "table" and open_tables:
                open_tables.pop()

        def handle_data(self, data: str) -> None:
            for c in cells:
                c.append(data)

    Reader(convert_charrefs=True).feed(source)
    kept = [[r for r in t if any(r)] for t in found]
    return [t for t in kept if t]
