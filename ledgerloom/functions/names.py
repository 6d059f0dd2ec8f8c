"""Strings of watch lists: normal names, programmes, aliases, null tokens."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Other names inside a remark (a fixed pattern that must match what is matched today, dotted forms included).
ALIAS = r"(?i)\b(?:a\.k\.a\.|aka|f\.k\.a\.|fka|n\.k\.a\.|nka)\b[\s:]*['\"]?([^;'\"]+?)['\"]?\s*(?:;|$)"


def normal_name(name: Column) -> Column:
    """Case folded (sharp s and final sigma too), ASCII punctuation as blanks, squeezed."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(F.translate(F.lower(name), "ς", "σ"), "ß", "ss"), r"[\p{Punct}]+", " "), r"(?U)\s+", " "))


def name_tokens(normal: Column) -> Column:
    return F.when(normal == "", F.array().cast("array<string>")).otherwise(F.array_distinct(F.split(normal, " ")))


def clean_programme(value: Column) -> Column:
    """``A] [B`` as ``A; B``."""
    parts = F.transform(F.split(value, r"\] \["), lambda p: F.regexp_replace(F.trim(p), r"^[\[\]]+|[\[\]]+$", ""))
    return F.array_join(F.filter(parts, lambda p: p != ""), "; ")


def null_token(value: Column) -> Column:
    return F.nullif(F.trim(value), F.lit("-0-"))


def remark_aliases(remarks: Column) -> Column:
    found = F.regexp_extract_all(F.coalesce(remarks, F.lit("")), F.lit(ALIAS), F.lit(1))
    return F.filter(F.transform(found, lambda a: F.trim(a)), lambda a: a != "")


def join_parts(sep: str, *parts: Column) -> Column:
    """Non-empty parts joined; null if there is none."""
    return F.nullif(F.array_join(F.filter(F.array(*parts), lambda p: p.isNotNull() & (p != "")), sep), F.lit(""))


def to_float(value: Column) -> Column:
    """A plain decimal number, else null."""
    return F.when(F.trim(value).rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), F.trim(value).try_cast("double"))
