"""References to records that do not exist, found with bitmaps over dictionary-encoded keys.

1. ``encode_keys`` gives each distinct referenced key a dense integer, in key order, so that the keys of one
   scope (a company) lie side by side.
2. ``period_bitmaps`` sets one bit a key in 64-bit words; a word that is all zero has no row, which is the
   compression.  There is one sparse bitmap per key range (word), period and role (reference, parent, tombstone).
3. ``orphan_bits`` computes ``reference AND NOT parent`` word by word with running ORs over the periods.
4. ``decode_bits`` turns the surviving bits into key numbers again.

Every step is an aggregate, a window over one word (64 keys) or an equi-join; no key, period or company is ever
gathered in one task, and repeated rows collapse in the map-side part of ``distinct``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.session import filled, materialise

WORD_BITS = 64


def encode_keys(keys: DataFrame, columns: Sequence[str], name: str = "key_no") -> DataFrame:
    """Dictionary of the distinct keys: ``columns`` plus a dense integer ``name`` in key order within key ranges.

    Rows with a null in any key column get no number.  The keys are range-partitioned (boundaries follow the
    distinct keys, so no scope makes a partition large), sorted and numbered; the dictionary is written to the shared
    folder because numbers must not change when a task is run again.
    """
    distinct = keys.select(*columns).dropna().distinct()
    ordered = distinct.repartitionByRange(*[F.col(c) for c in columns]).sortWithinPartitions(*columns)
    return materialise(ordered.withColumn(name, F.monotonically_increasing_id()), "dictionary")


def bit_of(key: str) -> Column:
    """The 64-bit word with the one bit of this key set."""
    return F.expr(f"shiftleft(1L, cast({key} & {WORD_BITS - 1} as int))")


def period_bitmaps(encoded: DataFrame, period: str, roles: Sequence[str], key: str = "key_no") -> DataFrame:
    """One row per (word, period) with the bitmap word of each boolean role column."""
    bits = [F.bit_or(F.when(F.col(r), bit_of(key)).otherwise(F.lit(0).cast("long"))).alias(r) for r in roles]
    return encoded.groupBy(F.shiftright(key, 6).alias("word"), F.col(period).alias("period")).agg(*bits)


def orphan_bits(bitmaps: DataFrame, *, as_of: bool) -> DataFrame:
    """``reference AND NOT parent`` for each word and period, split by where the parent is instead.

    ``as_of=False``: the parent must be in the same period (a snapshot); ``deleted`` if an earlier period has it,
    else ``late`` if a later one has it, else ``missing``.
    ``as_of=True``: the parent must be in the same or an earlier period (a log); ``late`` if only a later one
    has it, else ``deleted`` if the word has a tombstone for it in any period, else ``missing``.
    """
    whole = Window.partitionBy("word")
    ordered = whole.orderBy("period")
    nothing = F.lit(0).cast("long")
    before = F.coalesce(F.bit_or("parent").over(ordered.rowsBetween(Window.unboundedPreceding, -1)), nothing)
    after = F.coalesce(F.bit_or("parent").over(ordered.rowsBetween(1, Window.unboundedFollowing)), nothing)
    out = bitmaps.withColumns({"before": before, "after": after})
    if as_of:
        out = out.withColumn("gone", F.bit_or("tombstone").over(whole))
        absent = "(reference & ~(parent | before))"
        kinds = {"late": f"{absent} & after", "deleted": f"{absent} & ~after & gone", "missing": f"{absent} & ~after & ~gone"}
    else:
        absent = "(reference & ~parent)"
        kinds = {"deleted": f"{absent} & before", "late": f"{absent} & ~before & after", "missing": f"{absent} & ~(before | after)"}
    return out.select("word", "period", *[F.expr(e).alias(k) for k, e in kinds.items()])


def decode_bits(words: DataFrame, key: str = "key_no") -> DataFrame:
    """Rows (key, period, orphan_kind) of the bits set in the three result words."""
    kinds = F.array(*[F.struct(F.lit(k).alias("orphan_kind"), F.col(k).alias("bits")) for k in ("deleted", "late", "missing")])
    live = words.filter("(deleted | late | missing) != 0").select("word", "period", F.explode(kinds).alias("k"))
    live = live.select("word", "period", "k.orphan_kind", "k.bits").filter("bits != 0")
    places = F.expr(f"filter(sequence(0, {WORD_BITS - 1}), i -> shiftright(bits, i) & 1L = 1L)")
    return live.select("word", "period", "orphan_kind", F.explode(places).alias("place")).select((F.shiftleft("word", 6) + F.col("place")).alias(key), "period", "orphan_kind")


def orphan_references(
    references: DataFrame,
    parents: DataFrame,
    key: Sequence[str],
    *,
    as_of: bool = False,
    tombstones: DataFrame | None = None,
) -> DataFrame:
    """References whose parent record is absent in the period of the reference.

    ``references``: ``record_id``, ``period`` and the ``key`` columns; ``parents``: ``period`` and ``key``;
    ``tombstones``: ``key`` of records known to be gone (used with ``as_of``).  Returns the distinct
    (record_id, period, key_no, orphan_kind).  A null in ``period`` or in a key column is no reference and no
    parent; repeated rows count once; empty inputs give an empty result; other columns are ignored.
    """
    key = list(key)
    references = references.select("record_id", "period", *key).dropna().distinct()
    parents = parents.select("period", *key).dropna().distinct()
    dictionary = encode_keys(references, key)
    cited = references.join(dictionary, key)
    no, yes = F.lit(False), F.lit(True)
    roles = cited.select("key_no", "period", yes.alias("reference"), no.alias("parent"), no.alias("tombstone"))
    known = parents.join(dictionary, key).select("key_no", "period", no.alias("reference"), yes.alias("parent"), no.alias("tombstone"))
    roles = roles.unionByName(known)
    if tombstones is not None:
        gone = tombstones.select(*key).dropna().distinct().join(dictionary, key)
        roles = roles.unionByName(gone.select("key_no", F.lit("").alias("period"), no.alias("reference"), no.alias("parent"), yes.alias("tombstone")))
    survivors = decode_bits(orphan_bits(period_bitmaps(roles, "period", ("reference", "parent", "tombstone")), as_of=as_of))
    return cited.join(survivors, ["key_no", "period"]).select("record_id", "period", "key_no", "orphan_kind").distinct()


def run_month(run: str) -> Column:
    """``YYYY-MM`` of a run id that starts with its compact UTC time."""
    return F.concat(F.substring(run, 1, 4), F.lit("-"), F.substring(run, 5, 2))


def corpus_orphans(artifacts: DataFrame, inventory: DataFrame, log: DataFrame) -> DataFrame:
    """Orphans of both citing tables: (ref_table, record_id, run_month, orphan_kind), distinct."""
    by_source = orphan_references(
        artifacts.filter(filled("source_id")).select(F.col("artifact_id").alias("record_id"), F.col("run_id").alias("period"), "company_id", "source_id"),
        inventory.select(F.col("run_id").alias("period"), "company_id", "source_id"),
        ["company_id", "source_id"],
    )
    cites = log.filter(filled("entity_id"))
    by_artifact = orphan_references(
        cites.select(F.col("event_id").alias("record_id"), F.col("run_id").alias("period"), F.col("entity_id").alias("artifact_id")),
        artifacts.select(F.col("run_id").alias("period"), "artifact_id"),
        ["artifact_id"],
        as_of=True,
        tombstones=cites.filter(F.col("event_type").isin("superseded", "unavailable")).select(F.col("entity_id").alias("artifact_id")),
    )
    named = [d.withColumn("ref_table", F.lit(n)) for d, n in ((by_source, "financial_artifact"), (by_artifact, "artifact_registry"))]
    return named[0].unionByName(named[1]).select("ref_table", "record_id", run_month("period").alias("run_month"), "orphan_kind").distinct()
