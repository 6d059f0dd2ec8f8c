"""Exports and gated publishing."""

from __future__ import annotations

import csv
import json
import os
import shutil
import tempfile
import time
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager, suppress
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.pystr import export_columns, redact
from ledgerloom.operators.validate import RULES, errors
from ledgerloom.sources.connectors import LISTS


def append_events(events: DataFrame, path: str, schema: str = "source_event") -> None:
    """Append valid events as JSON lines with sorted keys; if any event is invalid nothing is written."""
    bad = events.select(errors(RULES[schema]).alias("e")).filter(F.size("e") > 0).limit(1).collect()
    if bad:
        raise ValueError("; ".join(bad[0].e))
    jsonl(events, path, mode="append")


def jsonl(df: DataFrame, path: str, *, redacted: Sequence[str] = (), mode: str = "error") -> None:
    out = redact(df, list(redacted))
    out.select(F.to_json(F.struct(*sorted(out.columns)), {"ignoreNullFields": "false"}).alias("value")).write.mode(mode).text(path)


def csv_file(df: DataFrame, path: str, columns: Sequence[str], *, redacted: Sequence[str] = ()) -> None:
    """One CSV file with CRLF line ends, streamed row by row through the driver: for reports, not for tables."""
    rows = export_columns(redact(df, list(redacted)), list(columns))
    with open(path, "w", newline="", encoding="utf-8") as f:
        out = csv.writer(f)
        out.writerow(columns)
        for r in rows.toLocalIterator():
            out.writerow(list(r))


def markdown(df: DataFrame, path: str, columns: Sequence[str], title: str, *, redacted: Sequence[str] = ()) -> None:
    rows = export_columns(redact(df, list(redacted)), list(columns))
    cells = lambda r: "| " + " | ".join(str(c).replace("|", "\\|") for c in r) + " |"
    with open(path, "w", encoding="utf-8") as f:
        f.write(f"# {title}\n\n{cells(columns)}\n{cells(['---'] * len(columns))}\n")
        for r in rows.toLocalIterator():
            f.write(cells(r) + "\n")


def keep_list(df: DataFrame) -> DataFrame:
    """Entries whose list may be stored; lists for the session only are refused."""
    short = [n for n, kept in LISTS.items() if kept == "session_only"]
    return df.withColumn("list", F.when(F.col("list").isin(short), F.raise_error(F.concat(F.lit("may not be stored: "), "list"))).otherwise(F.col("list")))


def atomic_json(path: str, data: object) -> None:
    target = Path(path)
    handle, name = tempfile.mkstemp(dir=target.parent)
    with os.fdopen(handle, "w", encoding="utf-8") as f:
        json.dump(data, f, indent=2, sort_keys=True)
        f.flush()
        os.fsync(f.fileno())
    os.replace(name, target)


def publish(run_dir: str, latest: str, names: Sequence[str], *, passed: bool, history: str | None = None, published_at: str | None = None) -> bool:
    """Swap the named files of a run into ``latest`` if its gates passed; a file that is not there is left out.

    ``history``: folder that gets one record per published run, named by the run.
    """
    if not passed:
        return False
    staged, target = Path(f"{latest}.new"), Path(latest)
    shutil.rmtree(staged, ignore_errors=True)
    staged.mkdir(parents=True)
    for n in names:
        if (Path(run_dir) / n).exists():
            shutil.copy2(Path(run_dir) / n, staged / n)
    shutil.rmtree(target, ignore_errors=True)
    staged.rename(target)
    if history:
        Path(history).mkdir(parents=True, exist_ok=True)
        run = Path(run_dir).name
        atomic_json(str(Path(history) / f"{run}.json"), {"run_id": run, "published_at": published_at, "passed": True})
    return True


def _stale(path: Path, now: float, after: float) -> bool:
    """Whether a lock is older than ``after`` seconds; one that can't be read (just being written) is as old as its file."""
    try:
        since = float(json.loads(path.read_text())["at"])
    except FileNotFoundError:
        return True
    except (ValueError, KeyError, TypeError):
        since = path.stat().st_mtime if path.exists() else now
    return now - since > after


@contextmanager
def company_lock(folder: str, owner: str, now: float | None = None, stale_after: float = 3600.0) -> Iterator[None]:
    """One writer per company folder; a lock older than ``stale_after`` seconds is taken over.

    Of several writers that find a stale lock one moves it away; all then try to create the new one, and those that come
    second get ``RuntimeError`` as for any held lock.
    """
    path, now = Path(folder) / ".lock", time.time() if now is None else now
    path.parent.mkdir(parents=True, exist_ok=True)
    if path.exists() and _stale(path, now, stale_after):
        aside = path.with_name(f".lock-{uuid.uuid4().hex}")
        with suppress(FileNotFoundError):
            os.rename(path, aside)
            aside.unlink()
    try:
        handle = os.open(path, os.O_CREAT | os.O_EXCL | os.O_WRONLY)
    except FileExistsError:
        raise RuntimeError(f"locked: {path}") from None
    with os.fdopen(handle, "w") as f:
        json.dump({"owner": owner, "at": now}, f)
    try:
        yield
    finally:
        path.unlink(missing_ok=True)
