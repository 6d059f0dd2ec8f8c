from __future__ import annotations

import random

from conftest import rows

from ledgerloom.llm import leakage
from ledgerloom.llm.textnorm import words

VOCAB = [f"{a}{b}" for a in "bdfgklmnprst" for b in ("ar", "el", "in", "or", "un")]


def distance(pattern, text):
    """Smallest edit distance of the pattern to any stretch of the text, by the plain table."""
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        new = [i]
        for j, t in enumerate(text, 1):
            new.append(min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (p != t)))
        row = new
    return min(row)


def test_myers_equals_the_plain_table():
    rng = random.Random(1)
    for _ in range(400):
        p = [rng.choice("abc") for _ in range(rng.randrange(1, 20))]
        t = [rng.choice("abc") for _ in range(rng.randrange(0, 40))]
        assert leakage.myers(p, t, 99) == distance(p, t)


def test_against_brute_force(spark):
    rng = random.Random(2)
    items = [(i, " ".join(rng.choice(VOCAB) for _ in range(rng.randrange(10, 40))), "s") for i in range(12)]
    docs = []
    for d in range(80):
        base = [rng.choice(VOCAB) for _ in range(40)]
        src = words(items[rng.randrange(12)][1])
        n, at = rng.randrange(8, 22), rng.randrange(0, 8)
        piece = src[at : at + n]
        for k in range(0, len(piece), rng.choice([6, 11, 50])):
            if k:
                piece[k] = "zzz"
        docs.append((d, " ".join(base[:15] + piece + base[15:]).title(), d))
    want = set()
    for d, t, _ in docs:
        w = words(t)
        for i, s, _ in items:
            x = words(s)
            if any(distance(x[k : k + leakage.WINDOW], w) <= leakage.BUDGET for k in range(len(x) - leakage.WINDOW + 1)):
                want.add((d, i))
    d, i = spark.createDataFrame(docs, "doc_id long, text string, item_id int"), spark.createDataFrame(items, "item_id long, text string, suite string")
    assert rows(leakage.leaked_items(d, i)) == sorted(want, key=repr) and want
    assert rows(leakage.leaked_items(d, i, block=5)) == sorted(want, key=repr)


def test_disguises(spark):
    item = "The bonded quota narrowly outbid Seldenin's broker at dawn, whereas Borhalos turbine formally outbid every undated nominee under clause 92."
    docs = [
        (1, item.upper()), (2, item.replace(" ", "\n> ")), (3, "<p>" + item.replace("quota", "<b>quota</b>") + "</p>"), (4, item.replace("o", "о").replace("a", "а")), (5, item.replace("narrowly", "nar­rowly").replace(" fi", " ﬁ")),
        (6, item.replace("formally", "seven")), (7, "The bonded quota narrowly outbid it."), (8, None), (9, ""), (10, "x " * 200_000 + item + " y" * 1000), (11, item.replace("Seldenin's", "Seldenin’s").replace("outbid", "óutbíd")),
    ]
    got = leakage.leaked_items(spark.createDataFrame(docs + docs[:1], "doc_id long, text string"), spark.createDataFrame([(5, item), (6, None), (7, "too short")], "item_id long, text string"))
    assert [r[0] for r in rows(got.orderBy("doc_id"))] and {r[0] for r in rows(got)} == {1, 2, 3, 4, 5, 6, 10, 11}


def test_empty(spark):
    d, i = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    assert leakage.leaked_items(d, i).count() == 0
    assert leakage.leaked_items(spark.createDataFrame([(1, "a b")], "doc_id long, text string"), i).count() == 0
