"""Word sequences that do not depend on case, punctuation, markup, line breaks or look-alike characters."""

from __future__ import annotations

import html
import re
import unicodedata

#: Look-alike letters of other scripts and the Latin letters they imitate (fixed values).
LOOKALIKES = str.maketrans(
    "аеорсухіјѕԁһкмтнвгпАЕОРСУХІЈЅКМТНВοαενρτυικηΑΕΟΡΤΥΙΚΒΗΜΝΖΧıɑɡℓ",
    "aeopcyxijsdhkmthbrnAEOPCYXIJSKMTHBoaevptuiknAEOPTYIKBHMNZXiagl",
)
_TAG = re.compile(r"<!--.*?-->|</?[A-Za-z][^<>]*>", re.S)
_JOIN = re.compile("[\u00ad\u200b-\u200f\u2060\ufeff]+\\s?\n?|[-\u2010]\\s*\n\\s*(?=[a-z])")
#: Combining marks and format characters, which no word needs.
_MARK = re.compile("[\u0300-\u036f\u1ab0-\u1aff\u1dc0-\u1dff\u20d0-\u20ff\ufe20-\ufe2f\u00ad\u200b-\u200f\u202a-\u202e\u2060-\u2064\ufeff]+")
_WORD = re.compile(r"[^\W_]+")
_APOSTROPHE = re.compile("(?<=\\w)['\u2019\u02bc`](?=\\w)")


def plain(text: str) -> str:
    """Text without markup, hidden characters, hyphenation and letter variants; accents are dropped."""
    if "<" in text or "&" in text:
        text = html.unescape(_TAG.sub(" ", text))
    if not text.isascii():
        text = _JOIN.sub("", text) if "\u00ad" in text or "\u200b" in text else text
        text = _MARK.sub("", unicodedata.normalize("NFKD", text)).translate(LOOKALIKES)
    return text


def words(text: str | None) -> list[str]:
    """Lower-case words of a text; null and blank texts have none."""
    return _WORD.findall(_APOSTROPHE.sub("", plain(text)).lower()) if text else []
