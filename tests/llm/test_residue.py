from __future__ import annotations

import math
from collections import Counter

import pytest
from conftest import rows

from ledgerloom.llm import residue

SLOTS = [
    "Dear {{ name | default }}, hello.", "{% if country %} x", "Pay <%= report.revenue %> now", "in ${currency} duties", "of #{fiscal_year}", "%(auditor)s said", "%REGISTERED_OFFICE%", "@@company_name@@", "at __AUDITOR__ x", "[[report_date]]",
    "[Insert report date here]", "[your currency]", "[TBC: revenue]", "[REPORT DATE]", "about «CompanyName» and", "the {registered_office} moved", "value {0} of", "XX.X million", "[●] paid", "______ (name)", "<<subsidiary count>>", "&lt;company_name&gt; said", "by <registered office> x",
    "Revenue for undefined was NaN in null.", "The auditor is [object Object].", "Dear [Name], welcome.", "in {{" + "x" * 90 + "}} now", "[insert " + "a word " * 30 + "here]", "Lorem ipsum dolor sit amet.",
]
CLEAN = [
    "The set of risk classes is {low, medium, high}, and fees are quoted in $ per unit (see [8]).", 'The key `{"ico": "83992430"}` identifies the company.', "The clerk wrote [sic] next to the name; emphasis [added] is ours.", "Le conseil a dit « oui » hier.", "<p>A <b>bold</b> word.</p>", "As in [art_1a2b3c] and [12].",
    "Up 100% on 5_000 units.", "<Error><Code>NoSuchObject</Code></Error>",
]


@pytest.mark.parametrize("text", SLOTS)
def test_slots(text):
    assert residue.has_slot("Real content before. " + text)


@pytest.mark.parametrize("text", CLEAN)
def test_proper_signs(text):
    assert not residue.has_slot(text)


def test_documents(spark):
    real = "Net debt stood at EUR 3 million after the board sold the loan. The company employs about 900 people, most of them abroad. "
    docs = [
        (1, "404 Not Found. The page you requested could not be located."), (2, "<html><body><h1>Forbidden</h1><p>You do not have permission to view this resource.</p></body></html>"), (3, "Please enable JavaScript to view this page.\nHome\nSearch"),
        (4, "BITTE AKTIVIEREN SIE JAVASCRIPT, UM DIESE SEITE ANZUZEIGEN."), (5, real + "Sample text. " + real), (6, real + "in ${currency}."), (7, real), (8, real + "The phrase 'page not found' occurs 7 times in the complaint."),
        (9, real + "The product lets editors build a page from a template, and it works without JavaScript."), (10, None), (11, ""), (12, real + "Access was denied to the inspectors at the gate, the ministry said."), (13, real * 3000), (14, "Nachricht: " + real),
        (15, real + "The dummy company was dissolved; its placeholder directors had resigned earlier."), (16, "Home\nSearch\nLogin"),
    ]
    df = spark.createDataFrame([(d, t, "m") for d, t in docs] + [(1, docs[0][1], "m")], "doc_id long, text string, msgs string")
    assert rows(residue.residue_documents(df)) == [(1, "notice"), (2, "notice"), (3, "notice"), (4, "notice"), (5, "filler"), (6, "slot")]
    assert residue.residue_documents(df.filter("false")).count() == 0


def test_templates(spark):
    texts = ["Error code 5 at host alpha", "error code 7: at host beta", "revenue from sales grew fast", "a", "error code 5 at host alpha"]
    msgs = [(" ".join(m for m, _ in residue.messages(t.replace(":", ""))),) for t in texts]
    got = {r.msg: r.template for r in residue.mine_templates(spark.createDataFrame(msgs, "msg string")).collect()}
    assert got["error code <num> at host alpha"] == got["error code <num> at host beta"] == "error code <num> at host <*>"
    assert got["a"] == "a"


def test_a_verdict_does_not_depend_on_other_documents(spark):
    tail = " der später durch den endgültigen Inhalt ersetzt wird."
    docs = [(1, "Hier steht ein Blindtext" + tail), (2, "The requested page was not found on this server."), (3, "Please enable JavaScript to view this page.")]
    others = [(4, "Hier steht ein Absatz" + tail), (5, "The requested loan was not found on this server."), (6, "Please enable invoicing to view this page.")]
    found = [(1, "filler"), (2, "notice"), (3, "notice")]
    df = lambda d: spark.createDataFrame(d, "doc_id long, text string")
    assert rows(residue.residue_documents(df(docs))) == found
    assert [x for x in rows(residue.residue_documents(df(docs + others))) if x[0] <= 3] == found


def test_long_messages_are_compared_whole(spark):
    path = " ".join(f"{c}{c}" for c in "abcdefghijklmnopqrstuvwxy")
    long = f"the requested url {path} was not found on this server"
    got = {r.msg: r.template for r in residue.mine_templates(spark.createDataFrame([(long,), (long.replace("bb", "zz"),), (long.replace("bb", "yy"),)], "msg string")).collect()}
    assert set(got.values()) == {long.replace("bb", "<*>")}


UNSEEN = [
    "This site can't be reached.", "ERR_CONNECTION_CLOSED", "JavaScript required", "You must have JavaScript enabled to view this page.", "Please turn JavaScript on and reload the page.", "The page you requested cannot be displayed.",
    "We're sorry, this page isn't available.", "Your access to this site has been limited.", "An error occurred while processing your request.", "This app works best with JavaScript enabled.", "Unable to connect.", "Scripts are disabled.",
    "Enable JS and disable any ad blocker.", "The resource you are looking for has been removed.", "Please contact the site owner.", "Service temporarily unavailable.", "This application requires scripts to be enabled in your browser.", "Bitte JavaScript im Browser einschalten.",
    "Die Seite wurde leider nicht gefunden.", "La page est introuvable.", "Página no disponible.",
]
UNSEEN_FILLER = ["Your company name goes here.", "Edit this text block.", "Headline goes here.", "Insert text here.", "This text is a placeholder.", "Hier kommt ein Platzhalter Text."]


def test_wordings_that_are_no_examples(spark):
    """Recall of at least 0.9 on wordings that no example has, and none of the real texts."""
    real = "Net debt stood at EUR 3 million after the board sold the loan. The company employs about 900 people, most of them abroad. "
    held = [" ".join(m for m, _ in residue.messages(t)) for t in UNSEEN + UNSEEN_FILLER]
    assert not set(held) & {x for lines in residue.CLASSES.values() for x in lines}
    bad = [(i, t) for i, t in enumerate(UNSEEN)] + [(100 + i, real + t + " " + real) for i, t in enumerate(UNSEEN_FILLER)]
    good = [(200, real), (201, real + "He said that the page was missing from the annex."), (202, "The browser maker reported lower revenue in the quarter."), (203, real + "Access to the port was denied again.")]
    got = {r.doc_id for r in residue.residue_documents(spark.createDataFrame(bad + good, "doc_id long, text string")).collect()}
    assert len(got & {i for i, _ in bad}) >= 0.9 * len(bad) and not got & {i for i, _ in good}, sorted({i for i, _ in bad} - got)


def test_mined_templates_decide(spark):
    """Words that vary between the copies of a message count only where nothing is mined."""
    names = ["Zorban Keltis Marun Velo", "Quilen Astor Benid Yarn", "Ostrik Pelma Dovin Rusk", "Havel Munter Grosk Till", "Ibrik Sanlo Terva Nuun"]
    docs = spark.createDataFrame([(i, f"File {n} not found on the server.") for i, n in enumerate(names)], "doc_id long, text string")
    assert residue.residue_documents(docs).count() == 5 and residue.residue_documents(docs, mine=False).count() == 0


def expected_weights(texts):
    """The log odds by brute force over distinct texts of one message each."""
    seeds = {c: Counter(w for line in lines for w in residue.stems(residue.masked(line.split()))) for c, lines in residue.CLASSES.items()}
    known = set().union(*seeds.values())
    kinds = {(tuple(w for w in words if w in known), len(words)) for words in (residue.stems(residue.messages(t)[0][0]) for t in texts)}
    counts, total = Counter(w for words, _ in kinds for w in words), residue.PRIOR + sum(n for _, n in kinds)
    usual = {w: (counts[w] + residue.PRIOR * (residue.USUAL if w in residue.FUNCTION else residue.RARE)) / total for w in known}
    size = {c: sum(seen.values()) + residue.SMOOTH * len(seen) for c, seen in seeds.items()}
    return {c: {w: max(-residue.CAP, min(residue.CAP, math.log((n + residue.SMOOTH) / size[c] / usual[w]))) for w, n in seen.items()} for c, seen in seeds.items()}


def test_words_of_all_documents_count(spark):
    """Each of 28 569 different documents counts, so a word that a few of them use does too."""
    own = "browser cookies server the reload page captcha blocked refresh domain in you menu".split()
    texts = [" ".join(own[i // 13**k % 13] for k in range(4)) + " tender" for i in range(13**4)] + [f"{'loan ' * n}traceback" for n in range(1, 9)]
    got = residue.word_weights(spark.createDataFrame([(t,) for t in texts + texts[:50]], "text string").repartition(4))
    for c, weights in expected_weights(texts).items():
        assert got[c] == pytest.approx(weights, abs=1e-9)


def test_names_in_a_notice_do_not_make_its_words_usual(spark):
    letters = str.maketrans("0123456789", "bcdfghjklm")
    notices = [f"The file {str(i).translate(letters)} was not found on this server." for i in range(10000, 13000)]
    df = lambda texts: spark.createDataFrame([(t,) for t in texts], "text string")
    assert residue.word_weights(df(notices)) == residue.word_weights(df(notices[:1]))
