"""Matching entities across sources without keys: a mixture model over similarity vectors, fitted without labels.

1. Names are read into legal form, common words (counted over the records; short forms of them count as the word) and the rest, the
   core.  Several weak blocks join records: the core with one typing error on either side, its start with the seat, its start with
   country and initials, the registration number.  Repeats collapse before blocking, hot blocks are cut.
2. Each candidate pair becomes a vector of similarities on a fixed grid.  The pairs are counted by grid cell: the
   cells, whose number is bounded by the grid and not by the data, are what the mixture is fitted on, so every pair counts.
3. Two Gaussians with regularised variances are fitted by expectation maximisation until nothing changes.  It starts from the pairs
   that are more similar in the mean than their rivals and than the middle of the range.
4. Transitivity is part of the E step: a LEI names one record at most and a record has one LEI at most, so a pair's posterior is its odds
   over one plus the odds of all its rivals; what rivals take is counted by grid cell and fitted again until it is stable.
5. Output: the pairs with a posterior above one half.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.names import abbreviates, split_join
from ledgerloom.session import materialise

#: Country names and codes (fixed values) to ISO 3166 alpha-2.
COUNTRIES = {"norway": "NO", "norge": "NO", "nor": "NO", "czechia": "CZ", "czech republic": "CZ", "cze": "CZ", "cesko": "CZ", "finland": "FI", "suomi": "FI", "fin": "FI", "estonia": "EE", "eesti": "EE", "est": "EE", "united kingdom": "GB", "great britain": "GB", "uk": "GB", "gbr": "GB"}
#: Legal forms, long before short (fixed values): words without accents and dots, then (form, country).  ``as`` is Norwegian or Estonian.
FORMS = [
    ("allmennaksjeselskap", "asa", "NO"), ("aksjeselskap", "as", "NO"), ("aktsiaselts", "as", "EE"), ("osauhing", "ou", "EE"),
    ("julkinen osakeyhtio", "oyj", "FI"), ("osakeyhtio", "oy", "FI"), ("akciova spolecnost", "a.s.", "CZ"), ("spol s r o", "sro", "CZ"), ("spol s ro", "sro", "CZ"), ("s r o", "sro", "CZ"), ("sro", "sro", "CZ"), ("a s", "a.s.", "CZ"),
    ("public limited company", "plc", "GB"), ("limited", "ltd", "GB"), ("plc", "plc", "GB"), ("ltd", "ltd", "GB"), ("asa", "asa", "NO"), ("oyj", "oyj", "FI"), ("oy", "oy", "FI"), ("ou", "ou", "EE"), ("as", "as", ""),
]
#: A word of at least this share of all register names, beside at least so many different words, is common.
COMMON, BESIDE = 0.004, 8
#: Letters of a core's start.
STEM = 4
#: Records of a block that one task compares.
BLOCK_ROWS = 1000
FEATURES = ("f_name", "f_words", "f_form", "f_country", "f_seat", "f_number")
#: Least variance of a similarity; change of a posterior that counts as none; rounds after which a fit that still moves is an error.
RIDGE, STILL, ROUNDS = 0.02, 1e-4, 500
#: Share of attributes that are wrong by accident: a similarity is drawn from its Gaussian or, so often, evenly from 0 to 1.
STRAY = 0.01
#: Similarity of attributes of which one is not known: it says nothing.
UNKNOWN = -1.0
#: Bound of a pair's log odds.
BOUND = 60.0


def fold(text: str | None) -> str:
    """Lower case without accents; dots, hyphens and brackets part words."""
    bare = "".join(c for c in unicodedata.normalize("NFKD", text or "") if not unicodedata.combining(c)).lower()
    return " ".join(re.findall(r"[a-z0-9]+", bare.replace("ø", "o").replace("ł", "l")))


def parse_name(name: str | None, common: frozenset[str]) -> tuple[str, str, str, str]:
    """(core, common words, form, country of the form) of a company name; a place in brackets at the end does not count.

    A short form of one common word counts as that word; a common word glued to the core's end is cut off.  A name of common
    words only is its own core.
    """
    text = fold(re.sub(r"\([^()]*\)\s*$", "", name or ""))
    form = country = ""
    for words, kind, land in FORMS:
        found = re.search(rf"^{words}\b|\b{words}$", text)
        if found and found[0] != text:
            form, country, text = kind, land, (text[: found.start()] + " " + text[found.end() :]).strip()
            break
    core, other, stems = [], [], []
    for w in text.split():
        if w in common:
            other.append(w)
            continue
        longer = sorted({c for c in common if len(w) < len(c) and abbreviates(w, c)}, key=lambda c: (not c.startswith(w), len(c), c))
        glued = next((c for c in sorted(common, key=len, reverse=True) if len(w) > len(c) + 2 and w.endswith(c)), None)
        stem = next((c for c in sorted(common, key=len, reverse=True) if len(c) > STEM and w.startswith(c)), None)
        if stem:
            stems.append((w, stem))
        elif len(w) <= STEM and longer or longer and len(w) > STEM and w[:STEM] == longer[0][:STEM]:
            other.append(longer[0])
        elif glued:
            core.append(w[: -len(glued)])
            other.append(glued)
        else:
            core.append(w)
    # A longer form of a common word is that word where something else is left to be the core.
    other += [c for _, c in stems] if core else []
    core = core or [w for w, _ in stems]
    if not core:
        core, other = text.split(), []
    return "".join(core), " ".join(sorted(other)), form, country


def name_columns(df: DataFrame, common: list[str]) -> DataFrame:
    """``df`` (id, name and other columns) with core, words, form and land."""
    schema = df.schema.simpleString()[len("struct<") : -1].replace(":", " ")
    known = frozenset(common)

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            parsed = [parse_name(n, known) for n in f.name]
            yield f.assign(**{c: [p[i] for p in parsed] for i, c in enumerate(("core", "words", "form", "land"))})

    return df.mapInPandas(read, schema + ", core string, words string, form string, land string")


def common_words(names: DataFrame) -> list[str]:
    """Words in at least a share ``COMMON`` of the names that stand beside several other words.

    At most 1 / COMMON times the words of a name reach the driver, whatever the data.
    """
    folded = F.regexp_replace(F.lower("name"), r"[^\p{L}\p{N}]+", " ")
    forms = sorted({w for f, _, _ in FORMS for w in f.split()})
    words = names.select(F.filter(F.array_distinct(F.split(F.trim(folded), " ")), lambda w: (F.length(w) > 2) & ~w.isin(forms)).alias("ws"))
    beside = words.select("ws", F.explode("ws").alias("w")).select("w", F.explode_outer(F.array_remove("ws", F.col("w"))).alias("v"))
    counts = beside.groupBy("w").agg(F.count("*").alias("n"), F.approx_count_distinct("v").alias("beside"))
    total = names.select(F.count("*").alias("total"))
    common = counts.join(F.broadcast(total), (F.col("n") >= COMMON * F.col("total")) & (F.col("beside") >= BESIDE))
    return sorted(w for w in {fold(r.w).replace(" ", "") for r in common.select("w").toLocalIterator()} if len(w) > 3)


def digits(column: str) -> Column:
    """A registration number without separators and country prefix; null if it says nothing."""
    bare = F.upper(F.regexp_replace(F.col(column), r"[^0-9A-Za-z*]", ""))
    bare = F.regexp_replace(bare, r"^(NO|CZ|FI|EE|GB)(?=[0-9QX])", "")
    return F.when(F.length(F.regexp_replace(bare, "[^0-9]", "")) >= 3, bare)


def records_side(records: DataFrame) -> DataFrame:
    """One row per record id, the one pulled last: (id, name, country, postcode, city, number)."""
    order = F.struct("retrieved_at", "name", "address")
    last = records.filter("record_id is not null").groupBy("record_id").agg(F.max_by(F.struct("name", "jurisdiction", "reg_number", "address"), order).alias("r")).select("record_id", "r.*")
    seat = F.regexp_extract("address", r"(\d{4,5})\s+(\D+)$", 1)
    place = F.regexp_extract("address", r"(\d{4,5})\s+(\D+)$", 2)
    return last.select("record_id", "name", F.upper(F.trim("jurisdiction")).alias("country"), F.nullif(seat, F.lit("")).alias("postcode"), F.nullif(F.lower(F.trim(place)), F.lit("")).alias("city"), digits("reg_number").alias("number"))


def leis_side(leis: DataFrame) -> DataFrame:
    """One row per LEI, the one updated last."""
    order = F.struct("last_update", "legal_name", "city")
    last = leis.filter("lei is not null").groupBy("lei").agg(F.max_by(F.struct("legal_name", "country", "city", "postcode", "registered_as"), order).alias("r")).select("lei", "r.*")
    named = F.lower(F.trim("country"))
    code = F.upper(named)
    for name, iso in COUNTRIES.items():
        code = F.when(named == name, iso).otherwise(code)
    return last.select("lei", F.col("legal_name").alias("name"), F.nullif(code, F.lit("")).alias("country"), F.nullif(F.trim("postcode"), F.lit("")).alias("postcode"), F.nullif(F.lower(F.trim("city")), F.lit("")).alias("city"), digits("registered_as").alias("number"))


def block_keys(side: DataFrame) -> DataFrame:
    """Rows (key) per row of a side; keys of different kinds can't meet."""
    core = F.col("core")
    holes = F.transform(F.sequence(F.lit(1), F.length(core)), lambda i: F.concat(F.substring(core, F.lit(1), i - 1), F.substring(core, i + 1, F.length(core))))
    typed = F.transform(F.array_append(holes, core), lambda h: F.concat(F.lit("t|"), h))
    land = F.coalesce(F.col("country"), F.nullif(F.col("land"), F.lit("")))
    start = F.substring(core, 1, STEM)
    initials = F.array_join(F.transform(F.split("words", " "), lambda w: F.substring(w, 1, 1)), "")
    others = F.array(
        F.when(land.isNotNull(), F.concat_ws("|", F.lit("c"), start, initials, land)),
        F.when(F.col("postcode").isNotNull(), F.concat_ws("|", F.lit("p"), F.substring(core, 1, 2), F.col("postcode"))),
        F.when(F.col("city").isNotNull(), F.concat_ws("|", F.lit("s"), start, F.col("city"))),
        F.when(F.col("number").rlike(r"^[^*]{6,}$"), F.concat_ws("|", F.lit("n"), F.col("number"))),
    )
    keys = F.filter(F.array_union(F.when(F.length(core) >= 3, typed).otherwise(F.array().cast("array<string>")), others), lambda k: k.isNotNull())
    return side.withColumn("key", F.explode(F.transform(F.array_distinct(keys), lambda k: F.xxhash64(k))))


def candidates(records: DataFrame, leis: DataFrame) -> DataFrame:
    """Candidate pairs with both sides' attributes, each pair once."""
    cols = ["name", "country", "postcode", "city", "number", "core", "words", "form", "land"]
    ids = split_join(block_keys(leis).select("key", "lei"), block_keys(records).select("key", "record_id"), ["key"], "record_id", BLOCK_ROWS).select("record_id", "lei").distinct()
    a = records.select("record_id", *[F.col(c).alias(f"r_{c}") for c in cols])
    b = leis.select("lei", *[F.col(c).alias(f"l_{c}") for c in cols])
    return ids.join(a, "record_id").join(b, "lei")


def _same(a: Column, b: Column) -> Column:
    """1 equal, 0 different, ``UNKNOWN`` where one is not known."""
    known = a.isNotNull() & b.isNotNull() & (a != "") & (b != "")
    return F.when(~F.coalesce(known, F.lit(False)), UNKNOWN).when(a == b, 1.0).otherwise(0.0)


def features(pairs: DataFrame) -> DataFrame:
    """(record_id, lei, f_...): similarities on a fixed grid between 0 and 1."""
    a, b = F.col("r_core"), F.col("l_core")
    longest = F.greatest(F.length(a), F.length(b), F.lit(1))
    near = 1 - F.levenshtein(a, b) / longest
    short, long = F.least(F.length(a), F.length(b)), F.when(F.length(a) < F.length(b), b.startswith(a)).otherwise(a.startswith(b))
    name = F.when(a == b, 1.0).when((short >= STEM) & long, 0.9).otherwise(F.floor(near * 20) / 20)
    # Words of the one that the other lacks: none, on one side only, on both.
    mine, theirs = F.split("r_words", " "), F.split("l_words", " ")
    words = F.when(F.col("r_words") == F.col("l_words"), 1.0).when((F.size(F.array_except(mine, theirs)) == 0) | (F.size(F.array_except(theirs, mine)) == 0) | (F.col("r_words") == "") | (F.col("l_words") == ""), 0.4).otherwise(0.0)
    land = F.coalesce(F.col("l_country"), F.nullif(F.col("l_land"), F.lit("")))
    # Postcode and city say the same thing, so they count once: either agrees, nothing known, or moved.
    code, city = _same(F.col("r_postcode"), F.col("l_postcode")), _same(F.col("r_city"), F.col("l_city"))
    seat = F.when(code == 1, 1.0).when(city == 1, F.when(code == 0, 0.7).otherwise(0.9)).when((code == 0) | (city == 0), 0.0).otherwise(UNKNOWN)
    number = F.when(F.col("r_number").isNull() | F.col("l_number").isNull(), UNKNOWN)
    masked = F.regexp_replace("l_number", r"\*+$", "")
    mine, other = F.ltrim(F.col("r_number"), F.lit("0")), F.ltrim(F.col("l_number"), F.lit("0"))
    swapped = (F.array_sort(F.split(mine, "")) == F.array_sort(F.split(other, ""))) & (F.levenshtein(mine, other) <= 2)
    number = number.when(F.col("l_number").contains("*"), F.when(F.col("r_number").startswith(masked), 0.8).otherwise(0.0))
    number = number.when(mine == other, 1.0).when((F.levenshtein(mine, other) <= 1) | swapped, 0.9).otherwise(0.0)
    return pairs.select("record_id", "lei", name.alias("f_name"), words.alias("f_words"), _same(F.col("r_form"), F.col("l_form")).alias("f_form"), _same(F.col("r_country"), land).alias("f_country"), seat.alias("f_seat"), number.alias("f_number"))


def start(cells: np.ndarray) -> np.ndarray:
    """First log odds: 100 times what the mean of the known similarities lies above the middle of its range."""
    mean = np.ma.masked_equal(cells, UNKNOWN).mean(1).filled(0.0)
    return np.clip(100 * (mean - (mean.max() + mean.min()) / 2), -BOUND, BOUND)


def _moments(cells: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weighted mean and variance of each similarity over the pairs that know it; one that none knows has mean 0.5."""
    w = np.where(cells == UNKNOWN, 0.0, weight) + 1e-12
    known = np.where(cells == UNKNOWN, 0.5, cells)
    mean = (w * known).sum(0) / w.sum(0)
    return mean, (w * (known - mean) ** 2).sum(0) / w.sum(0)


def fit_mixture(cells: np.ndarray, weight: np.ndarray, matched: np.ndarray, kept: np.ndarray | float = 1.0) -> dict:
    """Two Gaussians over grid cells with ``weight`` pairs each, fitted until no posterior moves by ``STILL``.

    ``matched``: posteriors to start from; ``kept``: the share of each cell's posterior that rivals leave it.  Variances of the unmatched
    are shrunk half way to those of all pairs, and none falls below ``RIDGE``.
    """
    everywhere = _moments(cells, weight[:, None])[1]
    g, model = matched, {}
    for _ in range(ROUNDS):
        for k, r, shrunk in (("m", g, 0.0), ("u", 1 - g, 0.5)):
            usual = 1 - STRAY / _density(cells, *model[k]) if k in model else np.ones_like(cells)
            mean, var = _moments(cells, (r * weight)[:, None] * usual)
            model[k] = (mean, (1 - shrunk) * var + shrunk * everywhere + RIDGE)
        model["share"] = float(np.clip((g * weight).sum() / weight.sum(), 1e-6, 1 - 1e-6))
        after = kept / (1 + np.exp(-log_odds(cells, model)))
        if np.abs(after - g).max() < STILL:
            return model
        g = after
    raise RuntimeError("the mixture does not settle")


def _density(cells: np.ndarray, mean: np.ndarray, var: np.ndarray) -> np.ndarray:
    return (1 - STRAY) * np.exp(-0.5 * (cells - mean) ** 2 / var) / np.sqrt(2 * np.pi * var) + STRAY


def log_odds(cells: np.ndarray, model: dict) -> np.ndarray:
    """Log odds that a pair with these similarities is a match, bounded; unknown similarities say nothing."""
    logs = [np.log(p) + np.where(cells == UNKNOWN, 0.0, np.log(_density(cells, *model[k]))).sum(1) for k, p in (("m", model["share"]), ("u", 1 - model["share"]))]
    return np.clip(logs[0] - logs[1], -BOUND, BOUND)


def match(records: DataFrame, leis: DataFrame) -> DataFrame:
    """(record_id, lei, confidence) of the pairs with a posterior above one half.

    A null id takes no part; repeated rows count once; null attributes are unknown, not different; empty tables and
    tables without any candidate give no pairs; equally good rivals share, and then neither comes out.
    """
    spark = records.sparkSession
    a, b = records_side(records), leis_side(leis)
    common = common_words(a)
    a, b = materialise(name_columns(a, common), "records"), materialise(name_columns(b, common), "leis")
    pairs = materialise(features(candidates(a, b)), "pairs")
    grid = pairs.groupBy(*FEATURES).agg(F.count("*").alias("n")).toPandas()
    if grid.empty:
        return spark.createDataFrame([], f"record_id {records.schema['record_id'].dataType.simpleString()}, lei string, confidence double")
    cells, n = grid[list(FEATURES)].to_numpy(float), grid["n"].to_numpy(float)
    odds, kept, model = start(cells), np.zeros(len(n)), {}
    for _ in range(ROUNDS):
        held = compete(scored(pairs, grid, odds)).groupBy(*FEATURES).agg(F.sum("held").alias("held")).toPandas()
        posterior = 1 / (1 + np.exp(-odds))
        after = np.clip(grid.merge(held, on=list(FEATURES), how="left")["held"].fillna(0).to_numpy(float) / n / posterior, 0, 1)
        settled = np.abs((after - kept) * posterior * n).sum() < 0.01 * max(1.0, (posterior * kept * n).sum())
        kept = after
        if settled and model:
            break
        model = fit_mixture(cells, n, posterior * kept, kept)
        odds = log_odds(cells, model)
    best = compete(scored(pairs, grid, log_odds(cells, model))).filter("held > 0.5")
    return best.select("record_id", "lei", F.round("held", 4).alias("confidence"))


def scored(pairs: DataFrame, grid: pd.DataFrame, odds: np.ndarray) -> DataFrame:
    """Pairs with the log odds of their cell; the grid is bounded, so it goes to every executor."""
    table = pairs.sparkSession.createDataFrame(grid[list(FEATURES)].assign(odds=odds))
    return pairs.join(F.broadcast(table), list(FEATURES))


def compete(pairs: DataFrame) -> DataFrame:
    """``held``: the posterior of a pair, given that a LEI names one record at most and a record has one LEI at most.

    Sums per LEI and per record are aggregates joined back, so an id with very many candidates is no hot group.
    """
    own = pairs.withColumn("odds", F.exp("odds"))
    sums = [own.groupBy(side).agg(F.sum("odds").alias(f"all_{side}")) for side in ("lei", "record_id")]
    both = own.join(sums[0], "lei").join(sums[1], "record_id")
    return both.withColumn("held", F.col("odds") / (1 + F.greatest("all_lei", "all_record_id"))).drop("odds", "all_lei", "all_record_id")
