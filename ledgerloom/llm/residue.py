"""Template residue and error-page text.

Two detectors.  ``SLOTS`` finds unresolved template slots inside any record.  Fixed messages go three steps:

1. ``word_weights``: from labelled examples of notices, fillers and page furniture and from every document of the corpus, how much
   more often a class uses a word than the corpus does (log odds).
2. ``mine_templates``: a prefix tree of fixed depth over the distinct messages that may be anything but content.  A message goes to
   the leaf of its length, its first words and its telling words (log odds above 0 for some class) with their places; in a leaf, a
   place where a message agrees with most others is constant, the others are wildcards.  Messages that don't fit a leaf's template form the leaf's next ones.
3. Each template is classified once, by its constant words: filler, notice, neutral or content.  The verdict goes to its messages and
   by an equi-join to the documents.  Telling words are never wildcards and wildcards only take a message's odd words out of the
   count, so a verdict can't be lost because of other documents in the table.

A document is residue if it has an unresolved slot or a filler message, even once, or if its running text consists of notices.
"""

from __future__ import annotations

import html
import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm import residue_examples
from ledgerloom.session import materialise

#: First words that lead to a leaf, the share of constant places that a template must have, and the templates of a leaf beyond its first.
DEPTH, SIMILARITY, MORE = 1, 0.5, 2
#: Parts of text (many are repeated) whose reading is remembered before a new start; for speed alone.
REMEMBERED = 100_000
#: Letters of a word that count, so that inflections are one word.
STEM = 6
#: What the corpus's use of words is taken for before it is counted, worth so many words: of function words and of any other word.
PRIOR, USUAL, RARE = 50_000, 0.01, 0.0001
FUNCTION = set(
    "a an the of to in on at or and is are was be been being will this that it its we our for with by as from has have must may some too many here your you do not no own out up one two three "
    "der die das ein eine in im um zu ist sie ihr ihrem dies durch la le les des de del el los las en du et un une su ce para por es y"
    "".split()
)
#: Bound of a word's log odds, the odds of a word that no example holds, and the smoothing of counts.
CAP, PENALTY, SMOOTH = 5.0, -2.0, 0.5
#: Log odds (over the square root of the words) from which a message belongs to a class (one filler marks a whole document); of a single
#: word; of a stretch of filler.
LEAST, LEAST_ONE, LEAST_STRETCH = {"notice": 2.0, "filler": 3.5, "neutral": 2.0}, 4.0, 10.5
CLASSES = {"notice": residue_examples.NOTICE, "filler": residue_examples.FILLER, "neutral": residue_examples.NEUTRAL}

#: Forms of unresolved slots (fixed patterns); each stands for the syntax of a template language or of a drafting habit.
SLOTS = [
    r"\{\{[^{}\n]+\}\}", r"\{%[^%\n]+%\}", r"<%[=-]?[^%\n]+%>", r"[$#]\{[^{}\n]+\}",
    r"%\([A-Za-z_]\w*\)[sdif]", r"%%?[A-Z][A-Z0-9_]{2,}%%?", r"@@\w+@@", r"\b__[A-Z][A-Z0-9_]+__\b", r"\[\[[\w .|-]+\]\]", r"<<[\w .-]+>>",
    r"\*\|[A-Z][A-Z0-9_:]*\|\*", r"«[A-Z]\w+»", r"(?<![\w`{])\{[a-z][a-z0-9]*(?:_[a-z0-9]+)*\}(?![}`])", r"(?<![\w`{])\{\d\}(?![}`])",
    r"(?i:\[(?:insert|your|enter|type|fill in|choose|select|add)\s[^\[\]\n]+\])", r"(?i:\[(?:tbc|tbd|tba|todo)\b[^\[\]\n]*\])", r"(?i:\[[^\[\]\n]+\bgoes here\])",
    r"(?i:\[(?:(?:first|last|full|family|company|client|customer|recipient|sender|contact|project) )?(?:name|date|address|amount|signature)\])",
    r"\[(?!(?:SIC|ADDED|EMPHASIS ADDED|OMITTED|REDACTED|UNAUDITED|CONTINUED|RESTATED)\])[A-Z][A-Z_]+(?: [A-Z_]+)*\]",
    r"\bX{1,3}[.,]X{1,2}\b", r"\bX{4,}\b", r"\[[●•_ ]+\]", r"_{5,}", r"(?i:\[object object\])",
]
#: Values that a template printed where nothing was given (lower case).
UNSET = ("undefined was nan", "nan in null")
_SLOT = re.compile(rf"(?=[{{$#%@_\[<*«X])(?:{'|'.join(SLOTS)})")
#: Names of HTML elements; an angle bracket around any other name that is never closed is a slot.
HTML_NAMES = set(
    "a abbr address article aside audio b base bdi bdo big blockquote body br button canvas caption center cite code col colgroup data dd del details dfn dialog dir div dl dt em embed "
    "fieldset figcaption figure font footer form frame frameset h1 h2 h3 h4 h5 h6 head header hr html i iframe img input ins kbd label legend li link main map mark menu meta meter nav "
    "noframes noscript object ol optgroup option output p param picture pre progress q rp rt ruby s samp script search section select slot small source span strike strong style sub summary "
    "sup svg table tbody td template textarea tfoot th thead time title tr track tt u ul var video wbr xml".split()
)
_ANGLE = re.compile(r"<([A-Za-z][A-Za-z0-9]*(?:[ _-][A-Za-z0-9]+){0,4})>")

#: Words of the usual Latin filler (fixed values); a run of six of them is filler.
LATIN = (
    "lorem ipsum dolor sit amet consectetur adipiscing adipisicing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua enim ad minim veniam quis nostrud exercitation "
    "ullamco laboris nisi aliquip ex ea commodo consequat duis aute irure in reprehenderit voluptate velit esse cillum eu fugiat nulla pariatur excepteur sint occaecat cupidatat non proident "
    "sunt culpa qui officia deserunt mollit anim id est laborum"
)
#: A run of filler holds one of these at least.
LATIN_SIGNS = ("lorem", "ipsum", "dolor", "nostrud", "consect", "eiusmod", "ullamco", "incididunt", "aliqu")
_LATIN = re.compile(rf"(?i)\blorem\W+ipsum(?:\W+(?:{'|'.join(LATIN.split())})\b){{2}}|(?:\b(?:{'|'.join(LATIN.split())})\b\W+){{7}}")

_TAG = re.compile(r"<!--.*?-->|</?[A-Za-z!?][^<>]*>", re.S)
_SPLIT = re.compile(r"(?<=[.!?;:…])[\"'»”)]*\s+|\n+")
#: Status codes of failed requests; any other word with a digit is a number.
_CODE = re.compile(r"[45]\d\d")
_DIGIT = re.compile(r"\d")
_WORD = re.compile(r"[^\W_]+")
_END = re.compile(r"[.!?;:…][\"'»”)\]}]*$")


def has_slot(text: str) -> bool:
    """Whether a text has an unresolved slot or Latin filler."""
    low = text.lower()
    if _SLOT.search(text) or any(u in low for u in UNSET) or any(w in low for w in LATIN_SIGNS) and _LATIN.search(low):
        return True
    decoded = html.unescape(text) if "&" in text else text
    if "<" in decoded:
        for m in _ANGLE.finditer(decoded):
            name = m[1]
            if re.split(r"[ _-]", name)[0].lower() in HTML_NAMES and not re.search(r"[_ ]", name):
                continue
            if re.split(r"[ ]", name)[0].lower() in HTML_NAMES and "_" not in name and " " in name:
                continue
            if f"</{name}>" not in decoded:
                return True
    return False


def messages(text: str, seen: dict[str, tuple[str, bool]] | None = None) -> list[tuple[str, bool]]:
    """(message, is a sentence) of a text: lines and sentences, in lower case, without markup and punctuation; status codes become
    ``<code>``, other words with a digit ``<num>``.  ``seen`` remembers the parts read so far; a part without words is ``("", ...)`` there."""
    seen = {} if seen is None else seen
    bare = _TAG.sub("\n", html.unescape(text) if "&" in text else text)
    out = []
    for part in _SPLIT.split(unicodedata.normalize("NFKC", bare)):
        found = seen.get(part)
        if found is None:
            words = _WORD.findall(part.lower().replace("'", "").replace("’", ""))
            found = seen[part] = (masked(words), bool(_END.search(part.strip())))
        if found[0]:
            out.append(found)
    return out


def masked(words: list[str]) -> str:
    line = " ".join(words)
    if not _DIGIT.search(line):
        return line
    return " ".join(w if not _DIGIT.search(w) else "<code>" if _CODE.fullmatch(w) else "<num>" for w in words)


def stems(message: str) -> list[str]:
    return [w if w[0] == "<" else w[:STEM] for w in message.split()]


def word_weights(documents: DataFrame) -> dict[str, dict[str, float]]:
    """Log odds of each example word by class, against its use in all documents.

    Messages with the same example words in the same order and of the same length count once, so neither copies of a notice nor
    notices that differ in a name make its words usual.  The driver gets counts of example words only, so at most as many as the
    examples have.
    """
    seeds = {c: Counter(w for line in lines for w in stems(masked(line.split()))) for c, lines in CLASSES.items()}
    known = sorted(set().union(*seeds.values()))
    place = {w: i for i, w in enumerate(known)}

    def kinds(seen: dict[str, tuple[str, bool]]) -> pd.DataFrame:
        found = {(tuple(place[w] for w in words if w in place), len(words)) for words in map(stems, {m for m, _ in seen.values() if m})}
        return pd.DataFrame([(list(words), n) for words, n in found], columns=["words", "n"])

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: dict[str, tuple[str, bool]] = {}
        for f in frames:
            for t in f.text:
                messages(t, seen)
                if len(seen) >= REMEMBERED:
                    yield kinds(seen)
                    seen = {}
        yield kinds(seen)

    once = documents.select("text").dropna().mapInPandas(read, "words array<smallint>, n int").distinct()
    words = once.select(F.explode(F.array_append("words", F.lit(-1).cast("smallint"))).alias("word"), "n").groupBy("word").agg(F.count("*").alias("n"), F.sum("n").alias("total"))
    counts = {known[r.word] if r.word >= 0 else "": (r.n, r.total) for r in words.toLocalIterator()}
    total = PRIOR + (counts[""][1] if "" in counts else 0)
    out = {}
    for c, seen in seeds.items():
        size = sum(seen.values()) + SMOOTH * len(seen)
        usual = {w: (counts.get(w, (0, 0))[0] + PRIOR * (USUAL if w in FUNCTION else RARE)) / total for w in seen}
        out[c] = {w: max(-CAP, min(CAP, math.log((n + SMOOTH) / size) - math.log(usual[w]))) for w, n in seen.items()}
    return out


def odds(template: str, weights: dict[str, float]) -> float:
    """Log odds of a class for a template: its constant words, over the square root of their number."""
    words = [w for w in stems(template) if w != "<*>"]
    return sum(weights.get(w, PENALTY) for w in words) / math.sqrt(len(words)) if words else 0.0


def stretch(template: str, weights: dict[str, float]) -> float:
    """Highest sum of log odds over three or more neighbouring words."""
    best = total = 0.0
    n = 0
    for w in stems(template):
        x = weights.get(w, PENALTY)
        total, n = (x, 1) if total <= 0 else (total + x, n + 1)
        best = max(best, total if n > 2 else 0.0)
    return best


def verdict(template: str, weights: dict[str, dict[str, float]]) -> str:
    """filler, notice, neutral or content; a single word is no filler."""
    one = " " not in template
    rated = {c: odds(template, w) for c, w in weights.items() if not (one and c == "filler")}
    best = max(rated, key=rated.get)
    if rated[best] >= (LEAST_ONE if one else LEAST[best]):
        return best
    return "filler" if stretch(template, weights["filler"]) >= LEAST_STRETCH else "content"


def may_tell(message: str, weights: dict[str, dict[str, float]]) -> bool:
    """Whether a message can get another verdict than content, even if all the places that may be wildcards are."""
    words = stems(message)
    spare = len(words) - math.ceil(SIMILARITY * len(words))
    for c, w in weights.items():
        rated = [w.get(v, PENALTY) for v in words]
        good = sum([x for x in rated if x > 0])
        if good <= 0:
            continue
        if good + sum(sorted([x for x in rated if x <= 0])[spare:]) > 0 or c == "filler" and stretch(message, w) >= LEAST_STRETCH:
            return True
    return False


def documents_messages(documents: DataFrame, weights: dict[str, dict[str, float]]) -> DataFrame:
    """(doc_id, slot, words, msgs, ends): ``slot`` from the whole text, ``words`` in sentences, the messages that may be more than content
    and whether each is a sentence.  Sentences that can only be content are not written."""
    docs = documents.select("doc_id", "text").dropna()
    kind = docs.schema["doc_id"].dataType.simpleString()

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: dict[str, tuple[str, bool]] = {}
        told: dict[str, bool] = {}
        for f in frames:
            rows = []
            for d, t in zip(f.doc_id, f.text):
                if len(seen) >= REMEMBERED:
                    seen, told = {}, {}
                found = messages(t, seen)
                for m, _ in found:
                    if m not in told:
                        told[m] = may_tell(m, weights)
                kept = [(m, s) for m, s in found if told[m]]
                rows.append((d, has_slot(t), sum(m.count(" ") + 1 for m, s in found if s), [m for m, _ in kept], [s for _, s in kept]))
            yield pd.DataFrame(rows, columns=["doc_id", "slot", "words", "msgs", "ends"])

    return docs.mapInPandas(read, f"doc_id {kind}, slot boolean, words int, msgs array<string>, ends array<boolean>")


def mine_templates(msgs: DataFrame, telling: Iterable[str] = ()) -> DataFrame:
    """Distinct messages (``msg``) with their ``template``, by a prefix tree of fixed depth; words with a stem in ``telling`` stay constant.

    A leaf is told by length, first words and telling words.  A place is constant if more than half of the leaf's messages have one
    word there: counts by (leaf, place, word), combined map-side, so a leaf of any size is never a list.  A message that agrees with its
    leaf in fewer than ``SIMILARITY`` of its places is left for the next template of that leaf, and stays as it is after the last one.
    """
    own = F.array(*[F.lit(w) for w in sorted(telling)]).cast("array<string>")
    tokens = F.split("msg", " ")
    signs = F.array_join(F.transform(tokens, lambda t: F.when(F.array_contains(own, F.substring(t, 1, STEM)), t).otherwise("")), " ")
    left = msgs.select("msg").distinct().select("msg", F.xxhash64(F.size(tokens), F.substring_index("msg", " ", DEPTH), signs).alias("leaf"))
    found = []
    for _ in range(1 + MORE):
        placed = left.select("msg", "leaf", F.posexplode(F.split("msg", " ")).alias("place", "word"))
        sizes = left.groupBy("leaf").agg(F.count("*").alias("size"))
        major = placed.groupBy("leaf", "place", "word").agg(F.count("*").alias("n")).join(sizes, "leaf").filter("2 * n > size").select("leaf", "place", F.col("word").alias("usual"))
        fitted = placed.join(major, ["leaf", "place"], "left").groupBy("leaf", "msg").agg(
            F.avg(F.coalesce(F.col("word") == F.col("usual"), F.lit(False)).cast("int")).alias("share"),
            F.array_sort(F.collect_list(F.struct("place", F.when(F.col("word") == F.col("usual"), F.col("word")).otherwise("<*>").alias("word")))).alias("places"),  # as long as the message
        )
        fitted = materialise(fitted.select("leaf", "msg", "share", F.array_join(F.transform("places", lambda p: p["word"]), " ").alias("template")), "templates")
        found.append(fitted.filter(F.col("share") >= SIMILARITY).select("msg", "template"))
        left = fitted.filter(F.col("share") < SIMILARITY).select("msg", "leaf")
    found.append(left.select("msg", F.col("msg").alias("template")))
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


def judged_messages(msgs: DataFrame, weights: dict[str, dict[str, float]], mine: bool = True) -> DataFrame:
    """(msg, verdict) of the messages that are anything but content; each template is classified once.  ``mine=False``: every message is its own template."""
    telling = {w for of_class in weights.values() for w, x in of_class.items() if x > 0}
    templates = mine_templates(msgs, telling) if mine else msgs.select("msg", F.col("msg").alias("template"))

    def judge(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            said = [(t, v) for t in f.template.tolist() if (v := verdict(t, weights)) != "content"]
            yield pd.DataFrame(said, columns=["template", "verdict"], dtype=object)

    verdicts = templates.select("template").distinct().mapInPandas(judge, "template string, verdict string")
    return templates.join(verdicts, "template").select("msg", "verdict")


def residue_documents(documents: DataFrame, *, mine: bool = True) -> DataFrame:
    """(doc_id, reason) of the documents to exclude; reason: slot, filler or notice.

    A null text, an empty text and an empty table give nothing; repeated rows give one; a document with several reasons
    has the first of them.
    """
    weights = word_weights(documents)
    docs = materialise(documents_messages(documents, weights), "messages")
    said = docs.select("doc_id", F.explode(F.arrays_zip("msgs", "ends")).alias("m")).select("doc_id", F.col("m.msgs").alias("msg"), F.col("m.ends").alias("sentence"))
    size = F.length("msg") - F.length(F.replace("msg", F.lit(" "))) + 1
    judged = materialise(judged_messages(said.select("msg").distinct(), weights, mine), "verdicts")
    per = said.withColumn("size", size).join(judged, "msg").groupBy("doc_id").agg(
        F.max(F.col("verdict") == "filler").alias("filler"),
        F.sum(F.when(F.col("verdict") == "notice", F.col("size")).otherwise(0)).alias("notice_words"),
        F.sum(F.when((F.col("verdict") == "neutral") & F.col("sentence"), F.col("size")).otherwise(0)).alias("neutral_words"),
    )
    every = docs.select("doc_id", "slot", "words").join(per, "doc_id", "left")
    page = (F.col("notice_words") > 0) & (F.col("words") - F.col("notice_words") - F.col("neutral_words") <= F.col("notice_words"))
    rank = F.when(F.col("slot"), 1).when(F.col("filler"), 2).when(page, 3)
    first = every.withColumn("rank", rank).filter("rank is not null").groupBy("doc_id").agg(F.min("rank").alias("rank"))
    return first.select("doc_id", F.element_at(F.array(F.lit("slot"), F.lit("filler"), F.lit("notice")), F.col("rank")).alias("reason"))
