"""Schema rules compiled into one projection: required fields, enums, patterns and ranges, nested arrays included."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    """``path`` may hold ``[]`` for each element of an array, e.g. ``periods[].period_type``."""

    path: str
    kind: str  # required, enum, pattern, range
    arg: object = None


EVENT_TYPES = ["discovered", "retrieved", "canonicalized", "unavailable", "superseded", "validated"]
#: Rules of the documents (fixed values of the published schemas).
RULES: dict[str, list[Rule]] = {
    "source_event": [*[Rule(p, "required") for p in ("event_id", "event_time", "run_id", "entity_type", "entity_id", "event_type", "payload")], Rule("entity_type", "enum", ["source"]), Rule("event_type", "enum", EVENT_TYPES)],
    "artifact_event": [*[Rule(p, "required") for p in ("event_id", "event_time", "run_id", "entity_type", "entity_id", "event_type", "payload")], Rule("entity_type", "enum", ["artifact"]), Rule("event_type", "enum", ["extracted", "validated", "superseded", "unavailable"])],
    "source_inventory": [
        Rule("source_id", "pattern", "^src_[0-9a-f]{16}$"), Rule("source_priority", "enum", ["primary", "secondary", "signal"]), Rule("retrieval_status", "enum", ["ok", "unavailable", "error"]),
        Rule("diff_class", "enum", ["unchanged", "cosmetic_change", "table_change", "content_change", "unavailable", "new"]),
    ],
    "financial_artifact": [
        Rule("artifact_id", "pattern", "^art_[0-9a-f]{16}$"), Rule("source_id", "pattern", "^src_[0-9a-f]{16}$"), Rule("lineage", "required"),
        Rule("periods[].period_type", "enum", ["FY", "Q", "TTM", "LTM", "YTD"]), Rule("periods[].unit_scale", "enum", ["ones", "thousands", "millions", "billions"]),
        Rule("line_items[].scope", "enum", ["consolidated", "segment", "subsidiary", "non_gaap"]), Rule("line_items[].sign_convention", "enum", ["positive", "negative", "as_reported"]),
        Rule("line_items[].normalized_candidate.confidence", "range", (0.0, 1.0)),
    ],
}


def _field(value: Column, path: list[str]) -> Column:
    for p in path:
        value = value[p]
    return value


def _broken(value: Column, rule: Rule) -> Column:
    """Whether a value breaks a rule; null breaks only ``required``."""
    if rule.kind == "required":
        return value.isNull()
    if rule.kind == "enum":
        return F.coalesce(~value.isin(list(rule.arg)), F.lit(False))
    if rule.kind == "pattern":
        return F.coalesce(~value.rlike(str(rule.arg)), F.lit(False))
    low, high = rule.arg
    return F.coalesce(~value.between(low, high), F.lit(False))


def errors(rules: Sequence[Rule]) -> Column:
    """Array of ``path: kind`` messages; array elements are named by position, as in ``periods/0/period_type``."""
    parts = []
    for r in rules:
        head, _, tail = r.path.partition("[].")
        if not tail:
            value = _field(F.col(head.split(".")[0]), head.split(".")[1:])
            parts.append(F.when(_broken(value, r), F.array(F.lit(f"{head.replace('.', '/')}: {r.kind}"))).otherwise(F.array().cast("array<string>")))
            continue

        def message(e: Column, i: Column, r: Rule = r, head: str = head, tail: str = tail) -> Column:
            return F.when(e.isNotNull() & _broken(_field(e, tail.split(".")), r), F.concat(F.lit(f"{head}/"), i.cast("string"), F.lit(f"/{tail.replace('.', '/')}: {r.kind}")))

        parts.append(F.coalesce(F.array_compact(F.transform(head, lambda e, i: message(e, i))), F.array().cast("array<string>")))
    return F.concat(*parts)


def invalid_rows(df: DataFrame, schema: str, keys: Sequence[str]) -> DataFrame:
    """(keys, error), one row per broken rule."""
    return df.select(*keys, F.explode(errors(RULES[schema])).alias("error"))
