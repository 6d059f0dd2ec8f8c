from __future__ import annotations

import random
from datetime import UTC, datetime

from conftest import rows

from ledgerloom.streaming import changefeed
from ledgerloom.streaming.state import streamed_state

SCHEMA = "event_id string, event_time string, entity_id string, event_type string, ingest_seq long, version int, company_id string"
TYPES = [*changefeed.LIVE_TYPES, *changefeed.GONE_TYPES, "queued", None]
TIMES = ["2024-01-02T00:00:00Z", "2024-01-02T01:00:00+01:00", "2024-01-02 00:00:00", "2024-01-02T00:00:00.500Z", "2024-01-01T23:00:00-05:00", "NOT-A-DATE", "", None, "2024-13-01T00:00:00Z"]


def parse(t):
    try:
        d = datetime.fromisoformat(t.replace("Z", "+00:00"))
    except (ValueError, AttributeError):
        return None
    return d if d.tzinfo else d.replace(tzinfo=UTC)


def brute(data):
    last = {}
    for e, t, n, k, q, _, _ in data:
        if e is not None and q is not None and (e not in last or last[e][0] < q):
            last[e] = (q, t, n, k)
    best = {}
    for e, (_, t, n, k) in last.items():
        at = parse(t)
        if at and n is not None and k in TYPES[:6] and (n not in best or best[n][:2] < (at, e)):
            best[n] = (at, e, k)
    return sorted(((n, e) for n, (_, e, k) in best.items() if k not in changefeed.GONE_TYPES), key=repr)


def test_random_against_brute_force(spark, tmp_path):
    rng = random.Random(3)
    data = [(f"e{rng.randrange(60)}", rng.choice(TIMES), rng.choice(["a", "b", "c", "d", None]), rng.choice(TYPES), i, 1, "x") for i in range(150)]
    data += data[:20] + [(None, TIMES[0], "a", "retrieved", 5, 1, "x"), ("e1", TIMES[0], "a", "retrieved", None, 1, "x")]
    rng.shuffle(data)
    path = str(tmp_path / "feed.parquet")
    spark.createDataFrame(data, SCHEMA).repartition(3).write.parquet(path)
    assert rows(changefeed.apply_change_feed(spark, path)) == brute(data)


def test_batches_replays_and_late_arrivals(spark, tmp_path):
    """The same deliveries in several micro-batches, one of them again, give the same state."""
    path, folder = str(tmp_path / "in"), str(tmp_path / "out")
    first = [("e1", "2024-01-01T00:00:00Z", "a", "retrieved", 2, 1, "x")]
    late = [("e1", "2024-01-05T00:00:00Z", "a", "unavailable", 1, 1, "x"), ("e2", "2023-01-01T00:00:00Z", "a", "unavailable", 3, 1, "x")]
    schema = spark.createDataFrame(first, SCHEMA).schema
    for batch in (first, late, first):
        spark.createDataFrame(batch, SCHEMA).write.mode("append").parquet(path)
        feed = changefeed.deliveries(spark.readStream.schema(schema).parquet(path))
        changefeed.stream_upserts(feed, folder)
    state = changefeed.current_entities(changefeed.newest(spark.read.parquet(f"{folder}/upserts")))
    assert rows(state) == [("a", "e1")]


def test_empty_feed(spark, tmp_path):
    path = str(tmp_path / "none.parquet")
    spark.createDataFrame([], SCHEMA).write.parquet(path)
    assert changefeed.apply_change_feed(spark, path).count() == 0


def test_streamed_state_equals_batch(spark, tmp_path):
    from ledgerloom.operators.eventlog import entity_state

    rng = random.Random(4)
    data = [(f"e{i}", rng.choice(TIMES[:3]), rng.choice("abc"), rng.choice(TYPES), i, 1, "x") for i in range(60)]
    path = str(tmp_path / "log.parquet")
    spark.createDataFrame(data, SCHEMA).write.parquet(path)
    assert rows(streamed_state(spark, path)) == rows(entity_state(spark.read.parquet(path)))
