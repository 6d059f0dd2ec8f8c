"""Text of values as exports write it: null as None, booleans as True and False, whole floats with .0."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def export_text(column: Column, kind: T.DataType) -> Column:
    if isinstance(kind, T.BooleanType):
        text = F.when(column, "True").otherwise("False")
    elif isinstance(kind, T.DoubleType | T.FloatType):
        text = F.regexp_replace(F.lower(column.cast("string")), r"^(-?\d)\.0e(\d+)$", "$1e+$2")
    else:
        text = column.cast("string")
    return F.when(column.isNull(), "None").otherwise(text)


def export_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    """``columns`` in that order as text; a column that is not there is empty."""
    kinds = {f.name: f.dataType for f in df.schema}
    return df.select(*[export_text(F.col(c), kinds[c]).alias(c) if c in kinds else F.lit("").alias(c) for c in columns])


def redact(df: DataFrame, columns: list[str]) -> DataFrame:
    """``[REDACTED]`` in the named columns that are there, nulls included."""
    return df.withColumns({c: F.lit("[REDACTED]") for c in columns if c in df.columns})
