"""Mixing sources to target shares of the total size in tokens, each document whole and used at most so often.

1. ``token_sizes`` counts tokens with a public tokenizer whose file is a parameter.
2. ``plan_mix`` finds the largest total that all targets allow (a source can give at most its tokens times its allowed
   uses) and each source's quota.  Only one row per source reaches the driver.
3. ``split_quotas``: each source's documents lie in blocks by a hash; the quota is split over the blocks by a tree:
   every node divides its draws between its halves by a hypergeometric draw (exact counts, without replacement), so each shard
   knows its quota without seeing the others.  A block then takes its documents in a permuted order.  The chosen documents of
   a block are a shard of the output, shuffled within it.
4. Uses beyond the first come in whole passes over all documents of the source plus one partial pass, so no document is
   used more often than its source allows, and the uses of two documents of a source differ by one at most.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.session import materialise

#: Folder of the vocabulary files of public tokenizers, and the file used.
TOKENIZERS, VOCABULARY = "/opt/tokenizers", "byte_bpe_50k.tiktoken"
#: How the byte-level vocabulary parts a text into words (fixed value, published with the vocabulary).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Hash blocks of each source: a power of two.  A block is a unit of work.
BLOCKS = 256
SEED = 17


def source_form(column: str):
    """A source name in one spelling."""
    return F.regexp_replace(F.trim(F.lower(F.col(column))), r"[\s_-]+", "_")


def token_sizes(documents: DataFrame, folder: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, source, tokens); a null or empty text has no tokens, a null source stays null."""
    docs = documents.select("doc_id", source_form("source").alias("source"), "text")
    kind = docs.schema["doc_id"].dataType.simpleString()

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import tiktoken

        with open(f"{folder}/{vocabulary}", "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        encode = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        for f in frames:
            yield pd.DataFrame({"doc_id": f.doc_id, "source": f.source, "tokens": [len(encode(t)) if t else 0 for t in f.text]})

    return docs.mapInPandas(count, f"doc_id {kind}, source string, tokens long")


def plan_mix(sizes: DataFrame, targets: DataFrame) -> pd.DataFrame:
    """One row per target source: tokens, n, share, most, quota (tokens to draw over all uses).

    The total is the largest for which every source with a positive share can give its part.
    """
    have = sizes.filter("tokens > 0").groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("n"))
    wish = targets.groupBy(source_form("source").alias("source")).agg(F.max("target_share").alias("share"), F.max("max_repeats").alias("most")).filter("source is not null and share > 0")
    plan = wish.join(have, "source", "left").fillna(0, ["tokens", "n"]).orderBy("source").toPandas()
    if plan.empty:
        return plan.assign(quota=pd.Series(dtype=float))
    total = float((plan.tokens * plan.most.clip(lower=0) / plan.share).min())
    return plan.assign(quota=total * plan.share)


def split_quotas(counts: np.ndarray, draws: int, rng: np.random.Generator) -> np.ndarray:
    """How many of ``draws`` fall into each block: a binary tree of hypergeometric splits; at most ``counts`` each."""
    out = np.zeros(len(counts), dtype=np.int64)

    def part(lo: int, hi: int, k: int) -> None:
        if k == 0:
            return
        if hi - lo == 1:
            out[lo] = k
            return
        mid = (lo + hi) // 2
        left, right = int(counts[lo:mid].sum()), int(counts[mid:hi].sum())
        k_left = draw_split(left, right, k, rng)
        part(lo, mid, k_left)
        part(mid, hi, k - k_left)

    part(0, len(counts), int(min(draws, counts.sum())))
    return out


def draw_split(left: int, right: int, k: int, rng: np.random.Generator) -> int:
    """A hypergeometric draw of any size: how many of ``k`` draws without replacement fall to the left.

    The generator's own draw ends at 10^9.  Beyond it, each item is taken with one probability (two binomial draws): given how
    many were taken, all choices of that many are equally likely.  Then as many as are too many are given back, or as many as are
    missing are taken from the rest, by the same draw; their number is about the square root of ``k``, so a few rounds do.
    """
    if left + right < 10**9:
        return int(rng.hypergeometric(left, right, k))
    if k > (left + right) // 2:  # what stays behind is a draw too
        return left - draw_split(left, right, left + right - k, rng)
    if k <= 1000:
        x = 0
        for i in range(k):
            x += int(rng.integers(left + right - i) < left - x)
        return x
    share = k / (left + right)
    x, y = int(rng.binomial(left, share)), int(rng.binomial(right, share))
    if x + y > k:
        return x - draw_split(x, y, x + y - k, rng)
    return x + draw_split(left - x, right - y, k - x - y, rng)


def mix(documents: DataFrame, targets: DataFrame, *, folder: str = TOKENIZERS, vocabulary: str = VOCABULARY, seed: int = SEED) -> DataFrame:
    """(doc_id, source, tokens, uses, shard, position) of the chosen documents, ``uses`` from 1 to the source's ``max_repeats``.

    ``shard`` is the block, as a part of the output with all its sources, and ``position`` (from 0) the document's place in the shard's shuffled
    order; the n-th pass over a shard takes, in that order, the documents with at least n uses.

    Documents without tokens, with a source that is not a target or with a null id are never chosen; rows with one id
    count once (the largest); an empty table, or a target source that is missing in it, leaves nothing to choose, since no
    positive total keeps the shares.
    """
    spark = documents.sparkSession
    kind = documents.schema["doc_id"].dataType.simpleString()
    sizes = token_sizes(documents.filter("doc_id is not null"), folder, vocabulary)
    sizes = materialise(sizes.groupBy("doc_id").agg(F.max(F.struct("tokens", "source")).alias("s")).select("doc_id", "s.source", "s.tokens"), "sizes")
    plan = plan_mix(sizes, targets)
    live = plan[plan.quota > 0] if len(plan) else plan
    if live.empty:
        return spark.createDataFrame([], f"doc_id {kind}, source string, tokens long, uses int, shard int, position int")
    # Blocks: bounded counts (sources x BLOCKS) are what the splitting tree works on.
    placed = sizes.filter("tokens > 0").join(F.broadcast(spark.createDataFrame(live[["source"]])), "source").withColumn("order", F.xxhash64(F.lit(seed), "doc_id", "tokens")).withColumn("block", F.pmod("order", F.lit(BLOCKS)).cast("int"))
    blocks = placed.groupBy("source", "block").agg(F.count("*").alias("n"), F.sum("tokens").alias("tokens")).toPandas()
    rows = []
    for i, s in enumerate(live.itertuples()):
        whole = min(int(s.quota // s.tokens), int(s.most))  # passes in which every document of the source is used
        rest = s.quota - whole * s.tokens if whole < s.most else 0.0
        own = blocks[blocks.source == s.source]
        counts = np.zeros(BLOCKS, dtype=np.int64)
        tokens = np.zeros(BLOCKS, dtype=np.int64)
        counts[own.block], tokens[own.block] = own.n, own.tokens
        # Draws are tokens, so that a block's quota is a share of its own size; it ends on whole documents.
        quota = split_quotas(tokens, int(round(rest)), np.random.default_rng([seed, i]))
        rows += [(s.source, b, whole, int(q)) for b, q in enumerate(quota) if counts[b]]
    quotas = F.broadcast(spark.createDataFrame(rows, "source string, block int, whole int, quota long"))
    in_block = Window.partitionBy("source", "block").orderBy("order", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    drawn = placed.join(quotas, ["source", "block"]).withColumn("upto", F.sum("tokens").over(in_block))
    # Documents that lie whole within their block's quota are drawn.  Each block has one document at most that its quota
    # cuts; of these (sources x BLOCKS at most) the driver takes those that bring each source to its quota.
    drawn = materialise(drawn.withColumn("extra", (F.col("upto") <= F.col("quota")).cast("int")).withColumn("cut", (F.col("extra") == 0) & (F.col("upto") - F.col("tokens") < F.col("quota"))).drop("order", "upto", "quota"), "drawn")
    held = {r.source: r.t for r in drawn.filter("extra = 1").groupBy("source").agg(F.sum("tokens").alias("t")).toLocalIterator()}
    cut = drawn.filter("cut").select("source", "doc_id", "tokens").toPandas().sort_values(["tokens", "doc_id"], ascending=[False, True])
    wanted: dict[str, int] = {}
    for source, _, _, q in rows:
        wanted[source] = wanted.get(source, 0) + q
    more = []
    for source, docs in cut.groupby("source"):
        left = wanted[source] - held.get(source, 0)
        for d in docs.itertuples():
            if d.tokens <= left:
                more.append((d.doc_id,))
                left -= d.tokens
    added = F.broadcast(spark.createDataFrame(more, f"doc_id {kind}").withColumn("also", F.lit(1)))
    uses = F.col("whole") + F.col("extra") + F.coalesce("also", F.lit(0))
    chosen = drawn.join(added, "doc_id", "left").select("doc_id", "source", "tokens", uses.cast("int").alias("uses"), F.col("block").alias("shard")).filter("uses > 0")
    # Not the order of drawing, by which the drawn part of a source would come first.
    shuffled = Window.partitionBy("shard").orderBy(F.xxhash64(F.lit(seed + 1), "doc_id"), "doc_id")
    return chosen.withColumn("position", F.row_number().over(shuffled) - 1)


def actual_shares(chosen: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, target_share, max_repeats, n_documents, max_uses, used_tokens, actual_share), one row per target source."""
    used = chosen.groupBy("source").agg(F.count("*").alias("n_documents"), F.max("uses").alias("max_uses"), F.sum(F.col("tokens") * F.col("uses")).alias("used_tokens"))
    total = used.select(F.sum("used_tokens").alias("total"))
    wish = targets.groupBy(source_form("source").alias("source")).agg(F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats")).filter("source is not null")
    out = wish.join(used, "source", "left").fillna(0, ["n_documents", "max_uses", "used_tokens"]).crossJoin(F.broadcast(total))  # one row
    return out.select("source", "target_share", "max_repeats", "n_documents", "max_uses", "used_tokens", F.round(F.col("used_tokens") / F.col("total"), 6).alias("actual_share"))
