"""JSON schemas of the documents that have no table, and their validation as a column of error lists.

The fields, enums and patterns are those of the published schemas (fixed values).
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

INSTANT = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}Z$"
RUN, ARTIFACT, SOURCE = r"^[0-9]{8}T[0-9]{6}Z-[0-9a-z]{4,12}$", r"^art_[0-9a-f]{16}$", r"^src_[0-9a-f]{16}$"


def text(pattern: str | None = None, *, null: bool = False, filled: bool = False, of: list[str] | None = None) -> dict:
    out: dict = {"type": ["string", "null"] if null else ["string"]}
    return out | ({"pattern": pattern} if pattern else {}) | ({"minLength": 1} if filled else {}) | ({"enum": of} if of else {})


def number(low: float | None = None, high: float | None = None, *, whole: bool = False, null: bool = False) -> dict:
    out: dict = {"type": ["integer" if whole else "number"] + ["null"] * null}
    return out | ({} if low is None else {"minimum": low}) | ({} if high is None else {"maximum": high})


def array(items: dict) -> dict:
    return {"type": ["array"], "items": items}


def closed(null: bool = False, **fields: dict) -> dict:
    """An object with exactly these fields, all required."""
    return {"type": ["object"] + ["null"] * null, "properties": fields, "required": list(fields), "closed": True}


ANY, SOME, TRUTH = {"type": ["object"]}, {"type": ["object"], "minProperties": 1}, {"type": ["boolean"]}
COUNT, TEXTS = number(0, whole=True), array(text())
LINEAGE = closed(source_snapshot_id=text(filled=True), content_path=text(filled=True), locator=SOME, snippet=text(filled=True), extraction_prompt=closed(name=text(), version=text()))
ENTITY = closed(
    entity_id=text(), entity_type=text(of=["product", "service", "tier", "bundle", "feature", "platform", "module"]), source_native_name=text(), aliases=TEXTS, source_native_category_path=TEXTS, parent_entity_id=text(null=True),
    display_order=number(whole=True, null=True), description_quote=text(null=True), lifecycle_status=text(null=True), geography_scope=TEXTS,
    pricing_observations=array(closed(price_raw=text(), currency_reported=text(null=True), billing_interval=text(null=True), locator=SOME)), attributes=array(closed(name_native=text(), value_native=text(null=True), locator=SOME)),
    normalized_candidate=closed(null=True, family=text(), confidence=number(0, 1)),
)
CONFLICT = closed(
    conflict_id=text(), reason_code=text(of=["restatement", "currency_mismatch", "period_mismatch", "scope_mismatch", "gaap_vs_nongaap", "source_authority_conflict"]),
    members=array(closed(artifact_id=text(), value={"type": ["string", "number", "null"]}, scope=text(null=True), period=text(null=True), source_id=text())), note=text(null=True),
)
MODES = ["full_refresh", "incremental_refresh", "source_discovery_only", "source_retrieval_only", "extraction_only", "validation_only", "dossier_only", "compare_runs"]
SCHEMAS = {
    "product_artifact": closed(
        artifact_id=text(ARTIFACT), schema_version=text(), company_id=text(filled=True), run_id=text(filled=True), source_id=text(SOURCE), lineage=LINEAGE,
        source_context=closed(document_title=text(null=True), section_path=TEXTS, source_native_statement_name=text(null=True), table_id=text(null=True), page=number(whole=True, null=True)), entities=array(ENTITY), notes=text(null=True),
    ),
    "run_manifest": closed(
        run_id=text(RUN), company_id=text(filled=True), company_name=text(filled=True), started_at=text(INSTANT), completed_at=text(INSTANT, null=True), mode=text(of=MODES), input_parameters=ANY,
        reproducibility=closed(prompt_set_hash=text(null=True), schema_set_hash=text(null=True), model_id=text(null=True), tool_versions=ANY, normalizer_profile_versions=ANY, locale=text(null=True)),
        sources_discovered=COUNT, sources_retrieved=COUNT, sources_new=COUNT, sources_changed=COUNT, sources_unavailable=COUNT, artifacts_extracted=COUNT, schemas_validated=TRUTH, output_paths=TEXTS, warnings=TEXTS, errors=TEXTS,
    ),
    "company_dossier": closed(
        run_id=text(filled=True), company_id=text(filled=True), research_date=text(INSTANT), retrieval_window=closed(**{"from": text(INSTANT), "to": text(INSTANT)}),
        counts=closed(sources_discovered=COUNT, sources_used=COUNT, sources_changed=COUNT, sources_unavailable=COUNT), known_gaps=TEXTS, confidence_summary=text(of=["low", "medium", "high"]),
        sections=array(closed(key=text(), title=text(), claims=array(closed(text=text(), kind=text(of=["fact", "evidence", "inference"]), citations=TEXTS)))),
    ),
    "data_quality_report": closed(
        run_id=text(filled=True), company_id=text(filled=True), generated_at=text(INSTANT), passed=TRUTH, gates=array(closed(name=text(), passed=TRUTH, detail=text())), conflicts=array(CONFLICT), stale_sources=TEXTS, low_confidence=TEXTS, missing_source_classes=TEXTS,
    ),
    "extracted_artifact": closed(
        artifact_id=text(ARTIFACT), schema_version=text(), company_id=text(filled=True), run_id=text(filled=True), artifact_type=text(filled=True), source_id=text(SOURCE), original_format=text(), retrieved_at=text(INSTANT), extracted_at=text(INSTANT),
        confidence=number(0, 1), lineage=LINEAGE, value=ANY, notes=text(null=True),
    ),
}
_KINDS = {"object": dict, "array": list, "string": str, "number": int | float, "integer": int, "boolean": bool, "null": type(None)}


def _is(value: object, kind: str) -> bool:
    """Truth values are no numbers; 3.0 is an integer."""
    if isinstance(value, bool):
        return kind == "boolean"
    return isinstance(value, _KINDS[kind]) or kind == "integer" and isinstance(value, float) and value.is_integer()


def broken(value: object, schema: dict, at: str = "") -> Iterator[str]:
    """``path: rule`` of each broken rule; array elements are named by position."""
    if not any(_is(value, k) for k in schema["type"]):
        yield f"{at or '.'}: type"
        return
    if "enum" in schema and value not in schema["enum"] and value is not None:
        yield f"{at}: enum"
    if isinstance(value, str):
        if not re.search(schema.get("pattern", ""), value):
            yield f"{at}: pattern"
        if len(value) < schema.get("minLength", 0):
            yield f"{at}: minLength"
    elif isinstance(value, int | float) and not isinstance(value, bool):
        if not schema.get("minimum", value) <= value <= schema.get("maximum", value):
            yield f"{at}: range"
    elif isinstance(value, list):
        for i, x in enumerate(value):
            yield from broken(x, schema["items"], f"{at}/{i}".lstrip("/"))
    elif isinstance(value, dict):
        fields = schema.get("properties", {})
        yield from (f"{f'{at}/{k}'.lstrip('/')}: required" for k in schema.get("required", []) if k not in value)
        if schema.get("closed"):
            yield from (f"{f'{at}/{k}'.lstrip('/')}: additionalProperties" for k in sorted(value) if k not in fields)
        if len(value) < schema.get("minProperties", 0):
            yield f"{at}: minProperties"
        for k, rule in fields.items():
            if k in value:
                yield from broken(value[k], rule, f"{at}/{k}".lstrip("/"))


def json_errors(raw: Column, schema: str) -> Column:
    """The broken rules of a JSON document, sorted; text that is no JSON has the one error ``.: json``, null text has none."""
    rules = SCHEMAS[schema]

    def one(text: str) -> list[str]:
        try:
            return sorted(broken(json.loads(text), rules))
        except ValueError:
            return [".: json"]

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def check(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: one(t) if isinstance(t, str) else [])

    return check(raw)


def structural_errors(raw: Column, schema: str) -> Column:
    """The degraded check, for engines without Python workers: text that is no object, and required top fields that are missing."""
    keys = F.json_object_keys(raw)
    wanted = F.array(*[F.lit(k) for k in SCHEMAS[schema]["required"]])
    return F.when(raw.isNull(), F.array().cast("array<string>")).when(keys.isNull(), F.array(F.lit(".: type"))).otherwise(F.transform(F.array_sort(F.array_except(wanted, keys)), lambda k: F.concat(k, F.lit(": required"))))
