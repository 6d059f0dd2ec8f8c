from __future__ import annotations

import random

from conftest import rows

from ledgerloom.operators import orphans

FA = "artifact_id string, company_id string, run_id string, source_id string, event_id string"
INV = "company_id string, run_id string, source_id string, artifact_id string"
LOG = "event_id string, run_id string, entity_id string, event_type string"


def brute(fa, inv, log):
    out = set()
    have = {(c, r, s) for c, r, s, _ in inv}
    for a, c, r, s, _ in fa:
        if None in (a, c, r, s) or not s.strip() or (c, r, s) in have:
            continue
        runs = [x for k, x, y in have if k == c and y == s and x is not None]
        kind = "deleted" if any(x < r for x in runs) else "late" if any(x > r for x in runs) else "missing"
        out.add(("financial_artifact", a, f"{r[:4]}-{r[4:6]}", kind))
    made = {}
    for a, _, r, _, _ in fa:
        if a is not None and r is not None:
            made.setdefault(a, []).append(r)
    gone = {e for _, _, e, t in log if t in ("superseded", "unavailable")}
    for i, r, e, _ in log:
        if None in (i, r, e) or not e.strip():
            continue
        if e in made:
            if min(made[e]) > r:
                out.add(("artifact_registry", i, f"{r[:4]}-{r[4:6]}", "late"))
        else:
            out.add(("artifact_registry", i, f"{r[:4]}-{r[4:6]}", "deleted" if e in gone else "missing"))
    return sorted(out, key=repr)


def test_random_against_brute_force(spark):
    rng = random.Random(1)
    runs = [f"2024{m:02d}01T000000Z-aaaa" for m in range(1, 6)]
    pick = lambda xs: rng.choice(xs)
    fa = [(f"art{rng.randrange(40)}", pick("AB"), pick(runs), pick([f"s{rng.randrange(100)}", "", None, " "]) if rng.random() < 0.2 else f"s{rng.randrange(100)}", "x") for _ in range(200)]
    inv = [(pick("AB"), pick(runs), f"s{rng.randrange(100)}", None) for _ in range(200)] + [(None, runs[0], "s1", None), ("A", None, "s2", None)]
    log = [(f"e{rng.randrange(150)}", pick(runs), pick([f"art{rng.randrange(70)}", None]), pick(["extracted", "superseded", "validated", None])) for _ in range(200)]
    # one event id may cite one artifact only
    log = list({e[0]: e for e in log}.values()) * 2
    got = orphans.corpus_orphans(spark.createDataFrame(fa, FA), spark.createDataFrame(inv, INV), spark.createDataFrame(log, LOG))
    assert rows(got) == brute(fa, inv, log)


def test_empty_tables(spark):
    got = orphans.corpus_orphans(spark.createDataFrame([], FA), spark.createDataFrame([], INV), spark.createDataFrame([], LOG))
    assert got.count() == 0


def test_dense_numbers_in_key_order(spark):
    keys = spark.createDataFrame([("b",), ("a",), ("a",), (None,), ("c",)], "k string").coalesce(1)
    got = orphans.encode_keys(keys, ["k"]).orderBy("key_no").collect()
    assert [r.k for r in got] == ["a", "b", "c"]
