from __future__ import annotations

import numpy as np
import pytest
from conftest import rows

from ledgerloom.llm import mixing

DOCS = "doc_id long, text string, source string, tokens int"
TARGETS = "source string, target_share double, max_repeats int"


def corpus(n_a=300, n_b=60):
    return [(i, "alpha beta gamma " * (1 + i % 7), "Source A" if i % 2 else "source_a ", 0) for i in range(n_a)] + [(1000 + i, "delta " * (3 + i % 5), "source-b", 0) for i in range(n_b)] + [(9000, "x", None, 0), (9001, None, "source_a", 0), (None, "x", "source_a", 0), (9002, "x y z", "other", 0)]


def test_shares_and_caps(spark):
    docs = spark.createDataFrame(corpus() + corpus()[:5], DOCS)
    targets = spark.createDataFrame([("source_a", 0.6, 1), ("source_b", 0.4, 3)], TARGETS)
    chosen = mixing.mix(docs, targets)
    got = rows(chosen)
    assert len({g[0] for g in got}) == len(got) and got == rows(mixing.mix(docs, targets))
    assert all(1 <= g[3] <= (1 if g[1] == "source_a" else 3) for g in got)
    share = {r.source: r.actual_share for r in mixing.actual_shares(chosen, targets).collect()}
    assert abs(share["source_a"] - 0.6) < 0.01 and abs(share["source_b"] - 0.4) < 0.01
    uses_b = {g[3] for g in got if g[1] == "source_b"}
    assert max(uses_b) - min(uses_b) <= 1


def test_a_missing_source_or_table_leaves_nothing(spark):
    targets = spark.createDataFrame([("source_a", 0.5, 1), ("absent", 0.5, 1)], TARGETS)
    assert mixing.mix(spark.createDataFrame(corpus(), DOCS), targets).count() == 0
    assert mixing.mix(spark.createDataFrame([], DOCS), targets).count() == 0
    assert mixing.mix(spark.createDataFrame(corpus(), DOCS), spark.createDataFrame([], TARGETS)).count() == 0


@pytest.mark.parametrize("draws", [0, 1, 500, 12345])
def test_splitting_tree_is_exact(draws):
    counts = np.random.default_rng(1).integers(0, 300, 64)
    got = mixing.split_quotas(counts, draws, np.random.default_rng(2))
    assert got.sum() == min(draws, counts.sum()) and (got <= counts).all() and (got >= 0).all()
    big = np.full(64, 10**10)
    got = mixing.split_quotas(big, 10**11, np.random.default_rng(2))
    assert got.sum() == 10**11 and (got <= big).all()


def test_large_draws_are_exact():
    n, half, k = 6000, 10**10, 3
    draw = lambda k, left, right: np.array([mixing.draw_split(left, right, k, np.random.default_rng([k, i])) for i in range(n)])
    # Three draws from equal halves: 1/8, 3/8, 3/8, 1/8.
    share = np.bincount(draw(k, half, half), minlength=4) / n
    assert np.abs(share - np.array([1, 3, 3, 1]) / 8).max() < 0.03
    # One of a thousand: a Poisson number to be, which is 0 by chance exp(-2), never a normal one.
    assert abs((draw(2000, 10**7, 10**10 - 10**7) == 0).mean() - np.exp(-2)) < 0.02
    big = draw(10**6, half, 3 * half)
    assert abs(big.mean() - 250_000) < 30 and abs(big.std() / np.sqrt(10**6 * 3 / 16) - 1) < 0.05
    late = draw(4 * half - 3, half, 3 * half)
    assert late.min() >= half - 3 and late.max() <= half and abs((half - late).mean() - 0.75) < 0.05


def test_shards_are_shuffled(spark):
    targets = spark.createDataFrame([("source_a", 0.6, 1), ("source_b", 0.4, 3)], TARGETS)
    got = mixing.mix(spark.createDataFrame(corpus(8000, 4000), DOCS), targets).collect()
    shards = {}
    for r in got:
        shards.setdefault(r.shard, {})[r.position] = r
    assert len(shards) == mixing.BLOCKS and all(sorted(s) == list(range(len(s))) for s in shards.values()) and sum(map(len, shards.values())) == len(got)
    first, last = ([s[i].source for s in shards.values() for i in sorted(s) if (i < len(s) / 2) == part] for part in (True, False))
    assert abs(first.count("source_a") / len(first) - last.count("source_a") / len(last)) < 0.05
