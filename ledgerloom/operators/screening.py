"""Screening of names against list entries: exact equality, or every word of the query among the words of a candidate.

Exact matches are an equi-join on the normal name.  Partial ones are relational division that starts from each query's
rarest word, so that a word that stands in a third of all candidates is never what rows meet on if another exists.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.names import clean_programme, name_tokens, normal_name, null_token, remark_aliases


def candidates(entries: DataFrame, aliases: str = "aliases") -> DataFrame:
    """(entry_key, norm, tokens) of the name and all aliases of each entry."""
    names = F.concat(F.array("name"), F.coalesce(F.col(aliases), F.array().cast("array<string>")))
    each = entries.select("entry_key", F.explode(names).alias("n")).filter("n is not null").select("entry_key", normal_name(F.col("n")).alias("norm")).distinct()
    return each.withColumn("tokens", name_tokens(F.col("norm")))


def screen(queries: DataFrame, entries: DataFrame, aliases: str = "aliases") -> DataFrame:
    """(query, entry_key, match_type): ``exact`` before ``partial``; a query of one word matches exactly or not at all."""
    asked = queries.select("query", normal_name(F.col("query")).alias("norm")).distinct().withColumn("words", name_tokens(F.col("norm")))
    known = candidates(entries, aliases)
    exact = asked.select("query", "norm").join(known.select("entry_key", "norm"), "norm").select("query", "entry_key", F.lit(0).alias("rank"))
    words = known.select("entry_key", "norm", F.explode("tokens").alias("word"))
    often = words.groupBy("word").agg(F.count("*").alias("often"))
    several = asked.filter(F.size("words") > 1).select("query", "words", F.explode("words").alias("word"))
    rarest = several.join(often, "word", "left").groupBy("query", "words").agg(F.min(F.struct(F.coalesce("often", F.lit(0)).alias("often"), "word")).alias("r")).filter("r.often > 0")
    probe = rarest.select("query", "words", F.col("r.word").alias("word")).join(words, "word").join(known.select("entry_key", "norm", "tokens"), ["entry_key", "norm"])
    partial = probe.filter(F.size(F.array_except("words", "tokens")) == 0).select("query", "entry_key", F.lit(1).alias("rank"))
    best = exact.unionByName(partial).groupBy("query", "entry_key").agg(F.min("rank").alias("rank"))
    return best.select("query", "entry_key", F.when(F.col("rank") == 0, "exact").otherwise("partial").alias("match_type"))


def sdn_entries(sdn: DataFrame) -> DataFrame:
    """Entries of the twelve-column list: (entry_key, list, name, type, program, remarks, aliases)."""
    remarks = null_token(F.col("remarks"))
    return sdn.select(
        F.col("ent_num").cast("string").alias("entry_key"), F.lit("OFAC-SDN").alias("list"), F.coalesce("sdn_name", F.lit("")).alias("name"), F.coalesce(null_token(F.col("sdn_type")), F.lit("")).alias("type"),
        clean_programme(F.coalesce("program", F.lit(""))).alias("program"), remarks.alias("remarks"), remark_aliases(remarks).alias("aliases"),
    )
