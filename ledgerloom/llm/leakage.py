"""Evaluation passages that stand, whole or in part, in corpus documents: pigeonhole edit matching.

Every window of ``WINDOW`` consecutive words of a test item may differ from the document by up to ``BUDGET`` word
edits.  A window is split into ``BUDGET + 1`` pieces; a document stretch within the budget must hold one of the pieces
exactly (pigeonhole).  So the pieces of all windows are looked up at every word of a document, and each hit is
verified with Myers' bit-parallel edit distance over words for the windows that the piece belongs to.

The test items are a bounded set: they are taken in blocks of ``BLOCK_ITEMS`` items, each block's pieces go to the
executors once, and all documents pass by in one narrow scan.  No document is moved, whatever its length.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame

from ledgerloom.llm.textnorm import words

WINDOW = 15
BUDGET = 2
#: Items whose pieces are held in memory at once (about 1 KB an item and word position).
BLOCK_ITEMS = 20_000


def myers(pattern: Sequence[str], text: Sequence[str], most: int) -> int:
    """Smallest edit distance of ``pattern`` to any stretch of ``text``, or ``most + 1`` if above ``most``."""
    m, masks = len(pattern), {}
    for i, w in enumerate(pattern):
        masks[w] = masks.get(w, 0) | 1 << i
    full, high = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score, best = full, 0, m, m
    for w in text:
        eq = masks.get(w, 0)
        vertical = eq | minus
        horizontal = (((eq & plus) + plus) ^ plus) | eq
        up, down = minus | ~(horizontal | plus) & full, plus & horizontal
        score += (up & high != 0) - (down & high != 0)
        up, down = up << 1 & full, down << 1 & full
        plus, minus = down | ~(vertical | up) & full, up & vertical
        best = min(best, score)
    return min(best, most + 1)


class Pieces:
    """The pieces of all windows of a block of items."""

    def __init__(self, items: list[tuple[int, str]], window: int, budget: int) -> None:
        if window % (budget + 1):
            raise ValueError("the window must split into budget + 1 equal pieces")
        self.window, self.budget, self.size = window, budget, window // (budget + 1)
        self.items = {i: w for i, t in items if len(w := words(t)) >= window}
        self.places: dict[tuple[str, ...], list[tuple[int, int]]] = defaultdict(list)
        for i, w in self.items.items():
            for p in range(len(w) - self.size + 1):
                self.places[tuple(w[p : p + self.size])].append((i, p))

    def found(self, text: str | None) -> set[int]:
        """Items of which the text holds a window within the budget."""
        doc, out, tried = words(text), set(), set()
        size, get = self.size, self.places.get
        for at, gram in enumerate(zip(*[doc[k:] for k in range(size)])):
            for item, place in get(gram, ()):
                if item in out:
                    continue
                for k in range(self.budget + 1):  # the windows in which this piece is the k-th
                    start = place - k * size
                    if start < 0 or start + self.window > len(self.items[item]) or (item, start, at - place) in tried:
                        continue
                    tried.add((item, start, at - place))
                    begin = max(0, at - k * size - self.budget)
                    stretch = doc[begin : at + (self.budget + 1 - k) * size + self.budget]
                    if myers(self.items[item][start : start + self.window], stretch, self.budget) <= self.budget:
                        out.add(item)
                        break
        return out


def leaked_items(documents: DataFrame, items: DataFrame, *, window: int = WINDOW, budget: int = BUDGET, block: int = BLOCK_ITEMS) -> DataFrame:
    """Distinct (doc_id, item_id): the document holds a window of the item within the edit budget.

    Items of fewer than ``window`` words and rows with a null id or text match nothing; repeated rows give one pair;
    empty tables give none; other columns are ignored.
    """
    spark = documents.sparkSession
    held = sorted({(r.item_id, r.text) for r in items.select("item_id", "text").dropna().toLocalIterator()})
    docs = documents.select("doc_id", "text").dropna()
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, item_id {items.schema['item_id'].dataType.simpleString()}"
    out = spark.createDataFrame([], schema)
    for i in range(0, len(held), block):
        part = spark.sparkContext.broadcast(held[i : i + block])

        def scan(frames: Iterator[pd.DataFrame], part=part) -> Iterator[pd.DataFrame]:
            pieces = Pieces(part.value, window, budget)
            for frame in frames:
                rows = [(d, i) for d, t in zip(frame.doc_id, frame.text) for i in sorted(pieces.found(t))]
                yield pd.DataFrame(rows, columns=["doc_id", "item_id"])

        out = out.unionByName(docs.mapInPandas(scan, schema))
    return out.distinct()
