"""Tables inside HTML documents as rows, with a table function."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.functions import udtf

from ledgerloom.functions.text import tables_of
from ledgerloom.sources.connectors import Unavailable


class _HtmlTables:
    def eval(self, source: str) -> Iterator[tuple[int, int, list[str]]]:
        for t, rows in enumerate(tables_of(source or "")):
            for r, cells in enumerate(rows):
                yield t, r, cells


def html_tables(docs: DataFrame, key: str, source: str) -> DataFrame:
    """(key, table_ix, row_ix, cells) of every table of every document."""
    spark: SparkSession = docs.sparkSession
    spark.udtf.register("html_tables", udtf(_HtmlTables, returnType="table_ix int, row_ix int, cells array<string>"))
    docs.createOrReplaceTempView("_html_documents")
    return spark.sql(f"select d.`{key}`, t.* from _html_documents d, lateral html_tables(d.`{source}`) t")


def pdf_tables(*_: object) -> DataFrame:
    raise Unavailable("PDF extraction needs a PDF library, which is not installed")
