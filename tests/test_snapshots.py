from __future__ import annotations

import random
from datetime import datetime, timedelta

from conftest import rows

from ledgerloom.operators import snapshots

SCHEMA = "company_id string, run_id string, source_id string, retrieval_status string, content_hash string, ingested_at timestamp, change_kind string"
T0 = datetime(2024, 1, 1)


def norm(h):
    h = "".join((h or "").lower().split())
    return h.removeprefix("sha256:").removeprefix("sha-256:") or None


def brute(data):
    best, runs, out = {}, {}, set()
    for c, r, s, st, h, t, _ in data:
        if c is None or r is None:
            continue
        runs.setdefault(c, set()).add(r)
        if s is not None and ((c, r, s) not in best or best[c, r, s][0] < (t or datetime.min)):
            best[c, r, s] = (t or datetime.min, st, norm(h))
    for c, rs in runs.items():
        order = sorted(rs)
        for a, b in zip(order, order[1:]):
            for s in {k[2] for k in best if k[0] == c and k[1] in (a, b)}:
                x, y = best.get((c, a, s)), best.get((c, b, s))
                if x is None:
                    out.add((c, b, s, "added"))
                elif y is None:
                    out.add((c, b, s, "removed"))
                elif x[1] != y[1] or (x[1] == y[1] == "ok" and x[2] and y[2] and x[2] != y[2]):
                    out.add((c, b, s, "changed"))
    return sorted(out, key=repr)


def test_random_against_brute_force(spark):
    rng = random.Random(2)
    hashes = ["ab" * 4, "AB" * 4, "sha256:" + "ab" * 4, "cd" * 4, "", None, " ", "zz"]
    data = []
    for i in range(500):
        row = (rng.choice(["A", "B", None]) if rng.random() < 0.1 else rng.choice("AB"), f"2024010{rng.randrange(1, 6)}T", f"s{rng.randrange(25)}" if rng.random() < 0.97 else None, rng.choice(["ok", "ok", "error", "unavailable", None]), rng.choice(hashes), T0 + timedelta(seconds=i), "x")
        data += [row] * rng.choice([1, 1, 2])
    assert rows(snapshots.change_events(spark.createDataFrame(data, SCHEMA))) == brute(data)


def test_leaves_and_returns(spark):
    row = lambda r, s: ("A", r, s, "ok", "aa", T0, None)
    data = [row("1", "x"), row("2", "y"), row("3", "x"), row("1", "y"), row("3", "y")]
    assert rows(snapshots.change_events(spark.createDataFrame(data, SCHEMA))) == [("A", "2", "x", "removed"), ("A", "3", "x", "added")]
    spans = snapshots.validity_intervals(spark.createDataFrame(data, SCHEMA)).select("source_id", "first_run", "last_run")
    assert rows(spans) == [("x", "1", "1"), ("x", "3", "3"), ("y", "1", "3")]


def test_empty(spark):
    assert snapshots.change_events(spark.createDataFrame([], SCHEMA)).count() == 0
