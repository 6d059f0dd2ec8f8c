"""Run folders, reports as text, and screening against a saved list file."""

from __future__ import annotations

import re
from collections.abc import Callable
from datetime import datetime
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions.dates import stamp
from ledgerloom.operators import schemas
from ledgerloom.operators.schemas import MODES
from ledgerloom.operators.screening import screen
from ledgerloom.sources import lists
from ledgerloom.sources.connectors import LISTS
from ledgerloom.sources.sinks import atomic_json

#: Folders of a run (fixed values).
SUBFOLDERS = ["raw_sources", "raw_artifacts", "extracted_tables", "structured", "reports", "logs"]


def seed_manifest(run_id: str, company: str, name: str, mode: str, now: datetime, parameters: dict | None = None) -> dict:
    """The manifest of a run that has done nothing yet."""
    started = datetime.strptime(stamp(now), "%Y%m%dT%H%M%SZ").strftime("%Y-%m-%dT%H:%M:%SZ")
    counts = ("sources_discovered", "sources_retrieved", "sources_new", "sources_changed", "sources_unavailable", "artifacts_extracted")
    unset = dict.fromkeys(("prompt_set_hash", "schema_set_hash", "model_id", "locale"))
    return (
        {"run_id": run_id, "company_id": company, "company_name": name, "started_at": started, "completed_at": None, "mode": mode, "input_parameters": parameters or {}}
        | {"reproducibility": unset | {"tool_versions": {}, "normalizer_profile_versions": {}}, "schemas_validated": False}
        | dict.fromkeys(counts, 0) | {k: [] for k in ("output_paths", "warnings", "errors")}
    )


def create_run(root: str, company: str, mode: str, now: datetime, token: str, name: str | None = None, parameters: dict | None = None) -> Path:
    """A new run folder with its validated manifest; an existing run, a bad token, an unknown mode or an invalid manifest raises."""
    if mode not in MODES:
        raise ValueError(f"unknown mode: {mode}")
    if not re.fullmatch("[0-9a-z]{4,12}", token):
        raise ValueError(f"bad token: {token}")
    run = Path(root) / company / "runs" / f"{stamp(now)}-{token}"
    manifest = seed_manifest(run.name, company, name or company, mode, now, parameters)
    if errors := list(schemas.broken(manifest, schemas.SCHEMAS["run_manifest"])):
        raise ValueError(f"invalid manifest: {errors}")
    run.mkdir(parents=True, exist_ok=False)
    for s in SUBFOLDERS:
        (run / s).mkdir()
    atomic_json(str(run / "run_manifest.json"), manifest)
    return run


def report_markdown(report: DataFrame) -> str:
    """The gates of one run as a list."""
    gates = report.select("gate", "ordinal", "passed", "n_problems").orderBy("ordinal").toLocalIterator()
    return "\n".join(["# Data Quality", "", *[f"- {g.gate}: {'PASS' if g.passed else 'FAIL'} — {g.n_problems} problems" for g in gates], ""])


def _bis(spark: SparkSession, path: str) -> DataFrame:
    return lists.bis_json(spark.read.text(path, wholetext=True).select(F.col("value").alias("raw")))


READERS: dict[str, Callable[[SparkSession, str], DataFrame]] = {"OFAC-SDN": lists.sdn_csv, "EU-CONSOLIDATED": lists.eu_csv, "UK-FCDO": lists.uk_csv, "BIS-CSL": _bis, "UN-CONSOLIDATED": lists.un_xml}


def screen_list(queries: DataFrame, list_id: str, path: str) -> DataFrame:
    """Names (``query``) against one saved list, parsed once for all of them; an unknown list raises."""
    if list_id not in LISTS:
        raise ValueError(f"unknown list: {list_id}")
    entries = READERS[list_id](queries.sparkSession, path)
    return screen(queries, entries.withColumnRenamed("entry_id", "entry_key"))
