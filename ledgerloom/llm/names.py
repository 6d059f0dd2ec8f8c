"""Variant spellings of names typed by people: which list entries name the same person or organisation.

1. All names of an entry (main name, aliases, names inside the remarks) are read into tokens.  A name with a comma says which
   part is the surname.  Counted over all entries, such names tell which tokens are given names and which are surnames; without
   a comma both ends of a name may be the surname, and the reading that the entry's own names and the counts support is kept
   (several, if they can't be told apart).  Words that many organisations share are counted likewise.
2. Profiles meet in blocks of phonetic codes of their sorted tokens: the code of one token, whole or less one sound (so one
   wrong consonant still meets), with the initials of the others.  Blocks of more than ``BLOCK_ROWS`` profiles are split.
3. Pairs are compared with Jaro-Winkler and edit distance on the best alignment of tokens.  The tables of nicknames and of
   abbreviations only add agreement: names outside them are compared by their letters.
4. Accepted pairs are clustered by connected components.  Entries whose birth date is incomplete join a cluster only if
   one single cluster fits, so that two namesakes never flow together through a third entry.

Entries with the same profile are one node, so copies cost nothing before the result.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.session import materialise

#: Nicknames and other spellings of given names (fixed values); they only add agreement.
NICKNAMES = {
    "abdulrahman": "abdou abdelrahman abdalrahman", "aleksandr": "alexander sasha alex aleksander", "alexandra": "sandra aleksandra", "anastasia": "nastya anastasiya", "charles": "chuck charlie",
    "dmitri": "dima dmitriy dmitry", "edward": "ned ted eddie", "elizabeth": "liz beth elisabeth", "francisco": "paco pancho", "friedrich": "fritz", "gabriela": "gabi gabriella", "giuseppe": "beppe",
    "henrik": "rikke henrick", "ibrahim": "brahim ebrahim", "ignacio": "nacho", "johannes": "hans johann", "jose": "pepe", "katherine": "catherine kate kathy", "konstantin": "constantin kostya",
    "leonid": "lyonya", "margaret": "peggy maggie", "mikhail": "mihail misha", "mohammed": "muhammad hamada mohamed", "nikolai": "nicolay kolya nikolay", "patricia": "trish pat", "richard": "dick rick",
    "robert": "bob rob", "sebastian": "basti", "stanislav": "stanislaw stas", "svetlana": "sveta", "tatiana": "tatyana tanya", "theodore": "theo teddy", "vladimir": "vova volodya", "william": "bill will",
    "yekaterina": "ekaterina katya", "yevgeny": "evgenii zhenya evgeny", "youssef": "joe yusuf yousef",
}
GIVEN = {v: {k} for k, vs in NICKNAMES.items() for v in [k, *vs.split()]}
GIVEN["ted"] = {"edward", "theodore"}
TITLES = {"mr", "mrs", "ms", "dr", "gen", "prof", "sir", "hon", "sheikh", "col", "maj"}
#: Particles before surnames (fixed values); they don't count.
PARTICLES = {"al", "el", "bin", "ibn", "de", "del", "della", "di", "da", "dos", "van", "von", "der", "den", "la", "le"}
#: Abbreviations of organisations' words that letters alone don't tell (fixed values); they only add agreement.
DESCRIPTIVE = {
    "company": "co comp coy", "foundation": "foundn fdn found", "importexport": "impexp", "industrial": "indust ind industries", "trading": "trdg tradng trade", "international": "intl", "technical": "tec tech",
    "group": "grp", "brothers": "bros", "shipping": "shpg shiping", "bureau": "buro bur", "general": "gen genl",
}
WORDS = {v: k for k, vs in DESCRIPTIVE.items() for v in [k, *vs.split()]}
LEGAL = {"fze": "fze", "ltd": "ltd", "limited": "ltd", "gmbh": "gmbh", "jsc": "jsc", "llc": "llc", "sa": "sa", "plc": "plc", "inc": "inc", "ag": "ag"}
PHRASES = [("limited liability company", "llc"), ("limited liability co", "llc"), ("joint stock company", "jsc"), ("joint stock co", "jsc"), ("import export", "importexport"), ("imp exp", "importexport"), ("import and export", "importexport"), ("int l", "intl"), ("g m b h", "gmbh"), ("s a", "sa"), ("f z e", "fze"), ("l l c", "llc"), ("j s c", "jsc"), ("abd al rahman", "abdulrahman"), ("abd alrahman", "abdulrahman"), ("abd el rahman", "abdulrahman")]
#: Letters that sound alike (fixed values); vowels, h and y carry no sound of their own.
SOUNDS = str.maketrans({"c": "k", "q": "k", "w": "v", "f": "v", "z": "s", "x": "s", "d": "t", "p": "b", "j": "g", "n": "m"})
#: Jaro-Winkler similarity from which tokens are compared letter by letter.
ALIKE = 0.84
#: A token is a given name (a surname) if names with a comma use it so that many times as often as the other way.
ROLE = 4
#: A word of at least this share of the organisations, and of so many of them, tells nothing of its own.
COMMON_SHARE, COMMON_LEAST = 0.002, 20
#: Profiles of a block that are compared in one task.
BLOCK_ROWS = 2000
MONTHS = {m: i for i, m in enumerate("jan feb mar apr may jun jul aug sep oct nov dec".split(), 1)}

_ALIAS = re.compile(r"(?i)\b(?:a\.?\s?k\.?\s?a|f\.?\s?k\.?\s?a|n\.?\s?k\.?\s?a)\b\.?\s*(?:'([^']*(?:'(?=\w)[^']*)*)'|\"([^\"]*)\"|([^;]+))")
_BIRTH = re.compile(r"(?i)\b(?:d\.?o\.?b\.?|born|date of birth|year of birth)\b:?\s*([^;]+)")



def fold(text: str | None) -> list[str]:
    """Lower-case words without accents; hyphens (but for particles) and apostrophes join, other signs part."""
    bare = "".join(c for c in unicodedata.normalize("NFKD", text or "") if not unicodedata.combining(c)).lower()
    bare = bare.translate(str.maketrans({"ø": "o", "ł": "l", "ı": "i", "đ": "d", "ß": "ss", "æ": "ae"}))
    bare = re.sub(r"import\s*(?:-|&|/)\s*export|imp\s*(?:-|&|/)\s*exp", "importexport", bare)
    bare = re.sub(r"\b(al|el)-(?=\w)", r"\1 ", bare)
    bare = re.sub(r"(?<=\w)-(?=\w)|['’`]", "", bare)
    joined = " ".join(re.findall(r"[^\W\d_]+", bare))
    for phrase, short in PHRASES:
        joined = re.sub(rf"\b{phrase}\b", short, joined)
    return joined.split()


def birth(text: str | None) -> tuple[int | None, str | None]:
    """(year, full ISO date) of the birth date in a remark; either may be missing."""
    found = _BIRTH.search(text or "")
    if not found:
        return None, None
    t = found[1].strip().lower()
    if m := re.match(r"(\d{4})-(\d{1,2})-(\d{1,2})", t):
        y, mo, d = map(int, m.groups())
    elif m := re.match(r"(\d{1,2})[/.](\d{1,2})[/.](\d{4})", t):
        d, mo, y = map(int, m.groups())
    elif (m := re.match(r"(\d{1,2})\s+([a-z]{3})[a-z]*\.?,?\s+(\d{4})", t)) and m[2] in MONTHS:
        d, mo, y = int(m[1]), MONTHS[m[2]], int(m[3])
    elif m := re.search(r"\b(1[89]\d\d|20\d\d)\b", t):
        return int(m[1]), None
    else:
        return None, None
    return y, f"{y:04d}-{mo:02d}-{d:02d}"


def aliases(text: str | None) -> list[str]:
    """Other names inside a remark."""
    return [n.strip(" '\"") for m in _ALIAS.finditer(text or "") for n in m.groups() if n]


def kind_of(said: str | None, names: list[list[str]], dated: bool, comma: bool) -> str:
    """``p`` person, ``o`` organisation, ``?`` not known: by the entry's type, else by its words."""
    word = re.sub(r"[^a-z]", "", (said or "").lower())
    if word in ("individual", "person", "p", "i"):
        return "p"
    if word in ("entity", "organisation", "organization", "company", "e", "o"):
        return "o"
    if any(t in LEGAL or t in WORDS and t not in TITLES for n in names for t in n):
        return "o"
    return "p" if dated or comma else "?"


def read_entry(names: Sequence[str | None], remarks: str | None, said: str | None) -> dict:
    """``kind``, birth ``year`` and ``date``, and ``names``: each as ``left`` (tokens before a comma, else none) and ``right``."""
    year, date = birth(remarks)
    read, bare = [], []
    for name in [*names, *aliases(remarks)]:
        before, comma, after = (name or "").partition(",")
        left, right = fold(before), fold(after)
        if left and right and not any(t in LEGAL for t in right):
            read.append((left, right))
        elif left or right:
            read.append(([], fold(name)))
        bare.append([*left, *right])
    kind = kind_of(said, bare, bool(year), any(x for x, _ in read))
    if kind == "o":  # organisations have no surname
        read = [([], [*x, *y]) for x, y in read]
    distinct = sorted({(tuple(x), tuple(y)) for x, y in read})
    return {"kind": kind, "year": None if kind == "o" else year, "date": None if kind == "o" else date, "names": [{"left": list(x), "right": list(y)} for x, y in distinct]}


def _untitled(tokens: list[str], least: int) -> list[str]:
    while len(tokens) > least and tokens[0] in TITLES:
        tokens = tokens[1:]
    kept = [t for t in tokens if t not in PARTICLES]
    return kept if any(len(t) > 1 for t in kept) else tokens


def readings(left: list[str], right: list[str]) -> list[tuple[str, tuple[str, ...], tuple[str, ...]]]:
    """(surname, its pieces, the other names in order) of a name: one with a comma, else each end, also of two pieces."""
    if left:
        pieces = _untitled(left, 1)
        return [("".join(pieces), tuple(pieces), tuple(_untitled(right, 1)))]
    t = _untitled(right, 2)
    out = []
    for n in (1, 2):
        if len(t) > n or len(t) == n == 1:
            for pieces, others in ((t[-n:], t[:-n]), (t[:n], t[n:])):
                if all(len(x) > 1 for x in pieces):
                    out.append(("".join(pieces), tuple(pieces), tuple(others)))
    return list(dict.fromkeys(out))


def _near(a: str, b: str) -> bool:
    return a == b or abs(len(a) - len(b)) <= 1 and min(len(a), len(b)) > 3 and edits(a, b) <= 1


def persons(names: list[dict], flags: dict[str, str]) -> list[dict]:
    """The readings of an entry's names that its own names and the counted roles support best, each with the surname's
    spellings, the first names and the second names."""
    found = [readings(list(n["left"]), list(n["right"])) for n in names]
    heads: Counter = Counter(s for rs in found for s in {r[0] for r in rs})
    votes = {s: sum(any(_near(s, r[0]) for r in rs) for rs in found) for s in heads}

    def role(pieces: tuple[str, ...]) -> int:
        kinds = [flags.get(x, "") for x in pieces]
        return -1 if "g" in kinds else int(kinds == ["s"])

    rank = {r[0]: (votes[r[0]], role(r[1])) for rs in found for r in rs}
    # A token that is used as a given name elsewhere is a surname only if nothing else is left.
    best = max(((v, g) for v, g in rank.values() if g >= 0), default=None) or max(rank.values(), default=None)
    tops = sorted(s for s in rank if rank[s] == best)
    full = lambda s: sorted({x for x in s if len(x) > 1} or s)
    out: list[dict] = []
    for top in tops:
        if any(top in o["rare"] for o in out):
            continue
        rare, first, middle = set(), set(), set()
        for rs in found:
            for surname, _, others in rs:
                if _near(surname, top) and rank[surname][1] >= min(0, rank[top][1]):
                    rare.add(surname)
                    first |= set(others[:1])
                    middle |= set(others[1:2])
        out.append({"rare": sorted(rare), "first": full(first), "middle": full(middle)})
    return out


def bags(names: list[dict], flags: dict[str, str]) -> tuple[list[list[str]], list[str]]:
    """(sets of words of an organisation's names, legal forms); neighbouring own words also count as one, since names are cut apart."""
    found, legal = set(), set()
    for n in names:
        tokens = [*n["left"], *n["right"]]
        legal |= {LEGAL[t] for t in tokens if t in LEGAL}
        words = [t for t in tokens if t not in LEGAL]
        if not words:
            continue
        found.add(tuple(sorted(words)))
        for i in range(len(words) - 1):
            if not _common(words[i], flags) and not _common(words[i + 1], flags):
                found.add(tuple(sorted([*words[:i], words[i] + words[i + 1], *words[i + 2 :]])))
        glued: list[str] = []
        for i, w in enumerate(words):
            own = not _common(w, flags)
            if glued and own and not _common(words[i - 1], flags):
                glued[-1] += w
            else:
                glued.append(w)
        found.add(tuple(sorted(glued)))
    return [list(b) for b in sorted(found)], sorted(legal)


def _common(word: str, flags: dict[str, str]) -> bool:
    return "c" in flags.get(word, "") or word in WORDS


def profile(entry: dict, flags: dict[str, str]) -> dict:
    """One profile of all names of an entry; equal profiles are equal dicts."""
    sets, legal = bags(entry["names"], flags) if entry["kind"] != "p" else ([], [])
    alternatives = persons(entry["names"], flags) if entry["kind"] != "o" else []
    return {"kind": entry["kind"], "alts": alternatives, "bags": sets, "legal": legal, "year": entry["year"], "date": entry["date"]}


def codes(token: str) -> set[str]:
    """Phonetic codes: the sounds of the consonants, doubles once; whole and, if longer than three, less one sound.

    Up to three sounds say too little with one less: such a token has its letters too, whole and less one letter, so that
    two tokens one edit apart (swapped neighbours too) share a code.
    """
    sounds = re.sub(r"[aeiouyh]", "", token).translate(SOUNDS)
    ways = [sounds] + [sounds[:i] + sounds[i + 1 :] for i in range(len(sounds)) if len(sounds) > 3]
    letters = {"=" + token[:i] + token[i + 1 :] for i in range(len(token) + 1)} if len(sounds) <= 3 else set()
    return {re.sub(r"(.)\1+", r"\1", w) for w in ways} - {""} | letters


def _starts(name: str) -> set[str]:
    """Initials under which a given name may be written."""
    if len(name) == 1:
        return {name} | {v[0] for k, vs in NICKNAMES.items() for v in [k, *vs.split()] if any(w[0] == name for w in [k, *vs.split()])}
    return {name[0]} | {v[0] for k in GIVEN.get(name, ()) for v in [k]}


def keys(p: dict, flags: dict[str, str]) -> list[str]:
    """Block keys: codes of one token with the initials of the others."""
    out = set()
    for alt in p["alts"]:
        starts = sorted({i for f in alt["first"] for i in _starts(f)}) or ["?"]
        out |= {f"p|{i}|{c}" for t in alt["rare"] for c in codes(t) for i in starts}
    for bag in p["bags"]:
        own = [w for w in bag if not _common(w, flags)] or [" ".join(bag)]
        for w in own:
            rest = "".join(sorted(x[0] for x in bag if x != w)) if w in bag else ""
            out |= {f"o|{rest}|{c}" for c in codes(w)}
    return sorted(out)


def jaro_winkler(a: str, b: str) -> float:
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(len(a), len(b)) // 2 - 1
    taken, hit = [False] * len(b), []
    for i, ch in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not taken[j] and b[j] == ch:
                taken[j] = True
                hit.append(ch)
                break
    m = len(hit)
    if not m:
        return 0.0
    other = [ch for ch, t in zip(b, taken) if t]
    moved = sum(x != y for x, y in zip(hit, other)) / 2
    jaro = (m / len(a) + m / len(b) + (m - moved) / m) / 3
    start = next((i for i, (x, y) in enumerate(zip(a[:4], b[:4])) if x != y), min(4, len(a), len(b)))
    return jaro + start * 0.1 * (1 - jaro)


def edits(a: str, b: str) -> int:
    """Edit distance where swapped neighbours are one edit."""
    rows = [list(range(len(b) + 1))]
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            best = min(rows[-1][j] + 1, row[-1] + 1, rows[-1][j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                best = min(best, rows[-2][j - 2] + 1)
            row.append(best)
        rows.append(row)
    return rows[-1][-1]


def _alike(a: list[str], b: list[str]) -> float:
    """How well two sets of tokens agree: 1 the same, 0.9 one edit, 0.8 two edits of a long token, 0 otherwise."""
    best = 0.0
    for x in a:
        for y in b:
            if x == y:
                return 1.0
            if best < 0.9 and jaro_winkler(x, y) >= ALIKE and abs(len(x) - len(y)) <= 2:
                d = edits(x, y)
                best = max(best, 0.9 if d <= 1 else 0.8 if d == 2 and min(len(x), len(y)) >= 9 else 0.0)
    return best


def _names_agree(a: list[str], b: list[str]) -> float | None:
    """1 a name (or a nickname of it) in common, 0.8 an initial that fits or nearly the same name, None where one side has none, 0 otherwise."""
    if not a or not b:
        return None
    forms = lambda x: GIVEN.get(x, {x}) | {x}
    if any(len(x) > 1 and len(y) > 1 and forms(x) & forms(y) for x in a for y in b):
        return 1.0
    if any((len(x) == 1 or len(y) == 1) and _fits(x, y) for x in a for y in b):
        return 0.8
    return 0.8 if any(min(len(x), len(y)) > 4 and not (x in GIVEN and y in GIVEN) and any(jaro_winkler(v, w) >= 0.92 and edits(v, w) <= 1 for v in forms(x) for w in forms(y)) for x in a for y in b) else 0.0


def _fits(x: str, y: str) -> bool:
    """Whether an initial may stand for a name or its nickname; two initials for one name."""
    if len(x) == len(y) == 1:
        return x == y or any(x in starts and y in starts for starts in _FAMILIES)
    letter, name = (x, y) if len(x) == 1 else (y, x)
    return letter == name[0] or any(v[0] == letter for k in GIVEN.get(name, ()) for v in [k, *NICKNAMES[k].split()])


_FAMILIES = [{v[0] for v in [k, *vs.split()]} for k, vs in NICKNAMES.items()]


def abbreviates(a: str, b: str) -> bool:
    """Whether one word is a short form of the other: the same first letter, and its letters stand in the other in order; or both share a long stem."""
    short, long = sorted((a, b), key=len)
    if WORDS.get(a, a) == WORDS.get(b, b):
        return True
    if len(short) < 2 or short[0] != long[0]:
        return False
    rest = iter(long)
    if len(short) < len(long) - 1 and all(c in rest for c in short):
        return True
    stem = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(short))
    return stem >= 6 and stem >= len(short) - 3


def align(a: list[str], b: list[str]) -> float:
    """How well two sets of words agree, each word with one of the other set: 0 if one is left over, or if only short forms agree."""
    if len(a) != len(b):
        return 0.0
    left, sure, strong = list(b), 1.0, False
    for x in sorted(a, key=lambda w: (w not in b, -len(w))):
        rated = [(1.0 if x == y else 0.0 if not y else _alike([x], [y]) or (0.95 if abbreviates(x, y) else 0.0), y) for y in left]
        value, y = max(rated, default=(0.0, ""))
        if not value:
            return 0.0
        left.remove(y)
        sure *= value
        strong |= value in (1.0, 0.9, 0.8) and min(len(x), len(y)) > 2 and x not in WORDS
    return sure if strong and sure >= 0.7 else 0.0


def score(a: dict, b: dict) -> float:
    """How surely two profiles are one entity, 0 if they can't be."""
    kinds = {a["kind"], b["kind"]}
    if kinds == {"p", "o"}:
        return 0.0
    if "p" not in kinds:
        if a["legal"] and b["legal"] and not set(a["legal"]) & set(b["legal"]):
            return 0.0
        return max((align(x, y) for x in a["bags"] for y in b["bags"]), default=0.0)
    if a["date"] and b["date"] and a["date"] != b["date"] or a["year"] and b["year"] and a["year"] != b["year"]:
        return 0.0
    sure = max((_persons_agree(x, y) for x in a["alts"] for y in b["alts"]), default=0.0)
    dated = bool(a["date"] and b["date"])
    # Initials or missing middle names and a typing error together need a birth date.
    return sure if dated or sure >= 0.7 or (a["year"] and b["year"] and sure >= 0.55) else 0.0


def _persons_agree(a: dict, b: dict) -> float:
    rare = _alike(a["rare"], b["rare"])
    if not rare:
        return 0.0
    first, middle = _names_agree(a["first"], b["first"]), _names_agree(a["middle"], b["middle"])
    return 0.0 if not first or middle == 0.0 else rare * first * (0.9 if middle is None else middle)


def entries(sdn: DataFrame, watch: DataFrame) -> DataFrame:
    """(key, names, remarks, said) of both kinds of lists; ``said`` is the entry's type as it stands."""
    text = lambda c: F.nullif(F.trim(c), F.lit("-0-"))
    a = sdn.filter("ent_num is not null").select(F.concat(F.lit("SDN-"), F.col("ent_num").cast("string")).alias("key"), F.array("sdn_name").alias("names"), text("remarks").alias("remarks"), text("sdn_type").alias("said"))
    b = watch.filter("entry_id is not null").select(F.col("entry_id").alias("key"), F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>"))).alias("names"), F.col("remarks"), text("entry_type").alias("said"))
    return a.unionByName(b)


NAMES = "array<struct<left:array<string>,right:array<string>>>"
PROFILE = "struct<kind:string,alts:array<struct<rare:array<string>,first:array<string>,middle:array<string>>>,bags:array<array<string>>,legal:array<string>,year:int,date:string>"


def token_flags(read: DataFrame) -> DataFrame:
    """(token, flag): ``g`` given name, ``s`` surname, by the names with a comma; ``c`` common word, by the organisations."""
    each = read.select("key", "kind", F.explode("names").alias("n"))
    sides = each.filter("size(n.left) > 0").select("key", F.explode(F.concat(F.array(F.struct(F.array_join("n.left", "").alias("token"), F.lit(0).alias("given"))), F.transform("n.right", lambda t: F.struct(t.alias("token"), F.lit(1).alias("given"))))).alias("s"))
    roles = sides.select("key", "s.*").filter("length(token) > 1").distinct().groupBy("token").agg(F.sum("given").alias("g"), F.sum(1 - F.col("given")).alias("s"))
    role = roles.select("token", F.when(F.col("g") > ROLE * F.col("s"), "g").when(F.col("s") > ROLE * F.col("g"), "s").alias("flag")).filter("flag is not null")
    organisations = read.filter("kind = 'o'")
    total = organisations.select(F.count("*").alias("total"))  # one row
    words = organisations.select("key", F.explode(F.array_distinct(F.flatten(F.transform("names", lambda n: n["right"])))).alias("token")).groupBy("token").count()
    common = words.join(F.broadcast(total), (F.col("count") >= COMMON_SHARE * F.col("total")) & (F.col("count") >= COMMON_LEAST)).select("token", F.lit("c").alias("flag"))
    return role.unionByName(common)


def profiles(listed: DataFrame) -> DataFrame:
    """(key, node, p, keys): rows of one entry are read together; ``node`` is a 128-bit hash of the profile."""
    whole = listed.groupBy("key").agg(F.array_distinct(F.flatten(F.collect_set("names"))).alias("names"), F.concat_ws("; ", F.array_sort(F.collect_set("remarks"))).alias("remarks"), F.max("said").alias("said"))

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [{"key": k} | read_entry(n, r, s) for k, n, r, s in zip(f.key, f.names, f.remarks, f.said)]
            out = pd.DataFrame(rows, columns=["key", "kind", "year", "date", "names"])
            yield out.astype({"year": "Int32"})

    tokens = materialise(whole.mapInPandas(read, f"key string, kind string, year int, date string, names {NAMES}"), "read")
    used = tokens.select("key", F.explode(F.array_distinct(F.flatten(F.transform("names", lambda n: F.concat(F.array(F.array_join(n["left"], "")), n["left"], n["right"]))))).alias("token"))
    flags = used.join(token_flags(tokens), "token").groupBy("key").agg(F.collect_set(F.struct("token", "flag")).alias("flags"))

    def describe(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for e in f.to_dict("records"):
                known: dict[str, str] = {}
                for x in [] if e["flags"] is None else e["flags"]:
                    known[x["token"]] = known.get(x["token"], "") + x["flag"]
                e |= {"names": [{k: list(v) for k, v in n.items()} for n in e["names"]], "year": None if pd.isna(e["year"]) else int(e["year"])}
                p = profile(e, known)
                if p["alts"] or p["bags"]:
                    rows.append({"key": e["key"], "p": p, "keys": keys(p, known)})
            yield pd.DataFrame(rows, columns=["key", "p", "keys"])

    out = tokens.join(flags, "key", "left").mapInPandas(describe, f"key string, p {PROFILE}, keys array<string>")
    return out.withColumn("node", F.unhex(F.md5(F.to_json("p"))))


def split_join(left: DataFrame, right: DataFrame, by: Sequence[str], spread: str, most: int = BLOCK_ROWS, sizes: DataFrame | None = None) -> DataFrame:
    """An equi-join whose groups are cut where ``right`` has more than ``most`` rows of a key: each part meets all rows of
    ``left``, so nothing is lost and no task holds a whole hot group.  ``spread``: the column of ``right`` that tells the part;
    ``sizes``: ``hot_keys`` of ``right`` where they are known."""
    parts = hot_keys(right, by, most) if sizes is None else sizes
    part = F.pmod(F.xxhash64(spread), F.coalesce("parts", F.lit(1)))
    right = right.join(parts, list(by), "left").withColumn("part", part.cast("int")).drop("parts")
    left = left.join(parts, list(by), "left").withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))).drop("parts")
    return left.join(right, [*by, "part"]).drop("part")


def hot_keys(rows: DataFrame, by: Sequence[str], most: int) -> DataFrame:
    """(by, parts) of the keys with more than ``most`` rows; there is one at most for each ``most`` rows."""
    return rows.groupBy(*by).count().filter(F.col("count") > most).select(*by, F.ceil(F.col("count") / most).cast("int").alias("parts"))


def _plain(p: object) -> object:
    """A profile as it comes back from a frame, with lists and dicts only."""
    if isinstance(p, dict):
        return {k: _plain(v) for k, v in p.items()}
    return [_plain(v) for v in p] if hasattr(p, "__iter__") and not isinstance(p, str) else p


def compared(nodes: DataFrame) -> DataFrame:
    """(a, b, score) of the accepted pairs of nodes that share a block; years that differ never meet."""
    # A hash stands for the key: two keys with one hash only bring pairs that the comparison refuses.
    blocks = materialise(nodes.select("node", F.col("p.year").alias("year"), F.explode("keys").alias("k")).withColumn("k", F.xxhash64("k")), "blocks")
    hot = materialise(hot_keys(blocks, ["k"], BLOCK_ROWS), "hot")
    # Known years meet only the same year; incomplete ones meet every year of the block.
    dated, undated = blocks.filter("year is not null"), blocks.filter("year is null").drop("year")
    left = lambda d: d.withColumnRenamed("node", "a")
    right = lambda d: d.withColumnRenamed("node", "b")
    known = left(dated).join(right(dated), ["k", "year"]).filter("a < b") if hot.isEmpty() else split_join(left(dated), right(dated), ["k", "year"], "b").filter("a < b")
    pairs = known.select("a", "b").unionByName(split_join(left(undated), right(blocks.drop("year")), ["k"], "b", sizes=hot).select("a", "b"))
    pairs = pairs.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    p = nodes.select("node", "p")
    both = pairs.join(p.withColumnsRenamed({"node": "a", "p": "pa"}), "a").join(p.withColumnsRenamed({"node": "b", "p": "pb"}), "b")
    spelt = lambda q: F.flatten(F.transform(F.col(q)["alts"], lambda x: x["rare"]))
    close = F.exists(spelt("pa"), lambda x: F.exists(spelt("pb"), lambda y: F.levenshtein(x, y) <= 4))
    both = both.filter((F.col("pa.kind") != "p") & (F.col("pb.kind") != "p") | close)  # most pairs end here, in the JVM

    def rate(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            f["score"] = [score(_plain(x), _plain(y)) for x, y in zip(f.pa, f.pb)]
            yield f.loc[f.score > 0, ["a", "b", "score"]]

    return both.mapInPandas(rate, "a binary, b binary, score double")


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, comp): connected components by hash-to-min with pointer jumping until nothing changes, each round written to the shared folder."""
    both = materialise(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = materialise(nodes.select("node", F.col("node").alias("comp")), "labels")
    while True:
        near = both.join(labels.withColumnsRenamed({"node": "b", "comp": "seen"}), "b").groupBy("a").agg(F.min("seen").alias("seen"))
        step = labels.join(near, labels.node == near.a, "left").select("node", "comp", F.least("comp", F.coalesce("seen", "comp")).alias("low"))
        jump = labels.withColumnsRenamed({"node": "low", "comp": "lower"})
        after = materialise(step.join(jump, "low", "left").select("node", F.least("low", F.coalesce("lower", "low")).alias("comp"), F.col("comp").alias("was")), "labels")
        labels = after.select("node", "comp")
        if after.filter("comp <> was").isEmpty():
            return labels


def linked_entries(sdn: DataFrame, watch: DataFrame) -> DataFrame:
    """(key, entity): entries of one person or organisation share ``entity``.

    Rows without an id or without any readable name stand alone and do not come out; repeated rows count once; null or
    empty aliases and remarks are no names; empty lists give no rows.
    """
    listed = materialise(profiles(entries(sdn, watch)), "profiles")
    nodes = materialise(listed.dropDuplicates(["node"]).select("node", "p", "keys"), "nodes")
    edges = materialise(compared(nodes), "compared")
    # Sure pairs: organisations, and persons with one full birth date.
    date = nodes.select("node", F.when(F.col("p.kind") == "o", "org").otherwise(F.col("p.date")).alias("date"))
    edges = edges.join(date.withColumnsRenamed({"node": "a", "date": "da"}), "a").join(date.withColumnsRenamed({"node": "b", "date": "db"}), "b")
    sure = edges.filter("da is not null and db is not null").select("a", "b")
    anchored = date.filter("date is not null").select("node")
    first = components(anchored, sure)
    # A node without a full date joins the one cluster that fits best; two that fit equally well leave it out.
    loose = edges.filter("da is null and db is not null").select(F.col("a").alias("node"), F.col("b").alias("to"), "score")
    loose = loose.unionByName(edges.filter("db is null and da is not null").select(F.col("b").alias("node"), F.col("a").alias("to"), "score"))
    claims = loose.join(first.withColumnRenamed("node", "to"), "to").groupBy("node", "comp").agg(F.max("score").alias("score"))
    best = claims.groupBy("node").agg(F.max(F.struct("score", "comp")).alias("top"))
    chosen = claims.join(best, "node").filter(F.col("score") >= F.col("top.score") - 1e-9).groupBy("node").agg(F.max("top.comp").alias("comp"), F.count("*").alias("ties"))
    joined = materialise(chosen, "chosen")
    held = joined.filter("ties = 1").select(F.col("node").alias("a"), F.col("comp").alias("b"))
    # Among nodes without a full date: pairs count where both belong to one cluster or neither fits any.
    state = joined.select("node", F.lit(True).alias("home"))
    free = edges.filter("da is null and db is null").select("a", "b").join(state.withColumnsRenamed({"node": "a", "home": "ha"}), "a", "left").join(state.withColumnsRenamed({"node": "b", "home": "hb"}), "b", "left")
    free = free.filter("ha is null and hb is null").select("a", "b")
    labels = components(nodes.select("node"), first.filter("node <> comp").select(F.col("node").alias("a"), F.col("comp").alias("b")).unionByName(held).unionByName(free))
    return listed.select("key", "node").join(labels, "node").select("key", F.col("comp").alias("entity"))


def same_entity_pairs(links: DataFrame) -> DataFrame:
    """(key_a, key_b), key_a < key_b: all pairs of an entity, which the result must hold."""
    several = links.groupBy("entity").count().filter("count > 1").select("entity")
    sides = [links.join(several, "entity").withColumnRenamed("key", k) for k in ("key_a", "key_b")]
    return split_join(*sides, ["entity"], "key_b").filter("key_a < key_b").select("key_a", "key_b")
