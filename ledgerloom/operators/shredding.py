"""Deeply nested records into related flat tables by shared inlining.

``schema_graph`` analyses the schema: structs that occur once below their parent are inlined as columns of the
parent's table; arrays and maps (repeated), structs whose definition occurs in several places (shared) and arrays
that contain themselves (recursive) get a table of their own.  Each child row carries ``row_key`` (its root record),
``parent_pos`` (the positions on the way down to its parent) and ``pos`` (its own position), which are the foreign
and primary keys.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SEP = "__"


@dataclass
class Node:
    """A relation of the shredded schema: where it hangs and which columns it inlines."""

    name: str
    path: tuple[str, ...]
    kind: str  # root, repeated, map, shared
    element: T.DataType
    columns: list[tuple[str, str]] = field(default_factory=list)
    children: list[Node] = field(default_factory=list)
    recursive: bool = False


def _signature(kind: T.StructType) -> str:
    return kind.simpleString()


def _count(kind: T.DataType, seen: Counter) -> None:
    if isinstance(kind, T.StructType):
        for f in kind.fields:
            inner = f.dataType
            if isinstance(inner, T.StructType):
                seen[(f.name, _signature(inner))] += 1
            _count(inner, seen)
    elif isinstance(kind, T.ArrayType):
        _count(kind.elementType, seen)
    elif isinstance(kind, T.MapType):
        _count(kind.valueType, seen)


def schema_graph(schema: T.StructType, root: str) -> Node:
    """The relations that ``schema`` inlines to."""
    seen: Counter = Counter()
    _count(schema, seen)

    def walk(node: Node, kind: T.StructType, prefix: tuple[str, ...], above: tuple[str, ...]) -> None:
        for f in kind.fields:
            path, inner = (*prefix, f.name), f.dataType
            name = SEP.join((node.name, *path)) if node.kind != "root" else SEP.join(path)
            if isinstance(inner, T.StructType) and seen[(f.name, _signature(inner))] == 1:
                walk(node, inner, path, above)
            elif isinstance(inner, T.StructType):
                child = Node(name, path, "shared", inner)
                node.children.append(child)
                walk(child, inner, (), (*above, f.name))
            elif isinstance(inner, T.ArrayType | T.MapType):
                mapped = isinstance(inner, T.MapType)
                element = inner.valueType if mapped else inner.elementType
                child = Node(name, path, "map" if mapped else "repeated", element, recursive=f.name in above)
                node.children.append(child)
                if isinstance(element, T.StructType):
                    walk(child, element, (), (*above, f.name))
                else:
                    child.columns.append(("value", "value"))
            else:
                node.columns.append((SEP.join(path), ".".join(f"`{p}`" for p in path)))

    top = Node(root, (), "root", schema)
    walk(top, schema, (), ())
    return top


def row_key(df: DataFrame) -> Column:
    """A key of the whole record, the same for rows that are the same: rows with one id but other content stay apart."""
    return F.md5(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]), {"ignoreNullFields": "false"}))


def link_positions(items: Column, reference: str, targets: Column, key: str, name: str, fields: Sequence[str]) -> Column:
    """``items`` with a foreign key ``name`` in each element: the last position in ``targets`` whose ``key`` equals the
    element's ``reference``; null where none does.  Positions count null elements; null elements stay null."""

    def link(item: Column) -> Column:
        place = F.array_max(F.transform(targets, lambda t, j: F.when(t[key] == item[reference], j)))
        return F.when(item.isNotNull(), F.struct(*[item[f].alias(f) for f in fields], place.alias(name)))

    return F.transform(items, link)


def shred(df: DataFrame, root: str = "record", carry: Sequence[str] = (), key: Column | None = None) -> dict[str, DataFrame]:
    """The flat tables of ``df``, by relation name.

    Root table: ``row_key`` and the inlined columns.  Child tables: ``row_key``, the root columns in ``carry``,
    ``parent_pos`` (array of int), ``pos`` (int, from 0, null elements counted), ``is_null`` for null elements, for
    maps ``map_key``, and the inlined columns.  A null or empty array yields no rows.  Repeated records yield repeated
    rows under one ``row_key``: ``distinct()`` of a table drops them, after pruning and without moving whole records.
    A nested column that would be called as a key column gets ``src__`` before its name.  The plan is narrow: no
    table needs a shuffle, and columns that a query does not use are not read.
    """
    taken = {"row_key", "pos", "parent_pos", "is_null", "map_key"}
    graph = schema_graph(df.schema, root)
    keyed = df.select((row_key(df) if key is None else key).alias("_k"), F.struct(*[F.col(f"`{c}`").alias(f"{c}") for c in carry]).alias("_c") if carry else F.lit(None).alias("_c"), F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_r"))
    out: dict[str, DataFrame] = {}

    def named(alias: str, used: set[str]) -> str:
        return f"src{SEP}{alias}" if alias in used else alias

    def emit(node: Node, base: DataFrame) -> None:
        # base: _k, _c, _at (positions down to this row, its own last), _r (element), _m (map key)
        used = taken if node.kind == "root" else taken | set(carry)
        head = [F.col("_k").alias("row_key")]
        if node.kind != "root":
            head += [F.col(f"_c.`{c}`") for c in carry]
            head += [F.slice("_at", 1, F.size("_at") - 1).alias("parent_pos"), F.element_at("_at", -1).alias("pos"), F.col("_r").isNull().alias("is_null")]
        if node.kind == "map":
            head.append(F.col("_m").alias("map_key"))
        scalar = node.kind != "root" and not isinstance(node.element, T.StructType)
        plain = [F.col("_r").alias("value")] if scalar else [F.col(f"_r.{p}").alias(named(a, used)) for a, p in node.columns]
        out[node.name] = base.select(*head, *plain)
        for child in node.children:
            at = F.col("_r." + ".".join(f"`{p}`" for p in child.path))
            if child.kind == "shared":
                rows = base.filter(at.isNotNull()).select("_k", "_c", F.concat("_at", F.array(F.lit(0))).alias("_at"), at.alias("_r"))
            elif child.kind == "map":
                rows = base.select("_k", "_c", "_at", F.posexplode(F.map_entries(at)).alias("_p", "_e"))
                rows = rows.select("_k", "_c", F.concat("_at", F.array("_p")).alias("_at"), F.col("_e.key").alias("_m"), F.col("_e.value").alias("_r"))
            else:
                rows = base.select("_k", "_c", "_at", F.posexplode(at).alias("_p", "_r")).select("_k", "_c", F.concat("_at", F.array("_p")).alias("_at"), "_r")
            emit(child, rows)

    emit(graph, keyed.withColumn("_at", F.array().cast("array<int>")))
    return out


def financial_tables(artifacts: DataFrame, carry: Sequence[str] = ("artifact_id",)) -> dict[str, DataFrame]:
    """Flat tables of financial artifacts: ``artifacts``, ``periods``, ``line_items`` and the further repeated parts.

    Each child row carries ``artifact_id`` (and the other columns of ``carry``); ``line_items.period_pos`` is the
    position of the item's period, the last one whose ``period_id`` equals the item's ``column_ref``, null where none
    does.
    """
    fields = artifacts.schema["line_items"].dataType.elementType.names
    linked = link_positions(F.col("line_items"), "column_ref", F.col("periods"), "period_id", "period_pos", fields)
    return shred(artifacts.withColumn("line_items", linked), "artifacts", carry, row_key(artifacts))
