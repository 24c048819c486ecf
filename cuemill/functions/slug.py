"""Slugs: file names made of titles. ASCII titles never leave the JVM."""

from __future__ import annotations

import re
import unicodedata
from functools import cache, lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed values.
MOST = 120
LEAST_RETAINED = 0.5
TRANSLITERATIONS = [("ø", "o"), ("ł", "l"), ("đ", "d"), ("ß", "ss"), ("æ", "ae"), ("œ", "oe"), ("þ", "th"), ("ð", "d")]
QUOTE_MARKS = "['‘’\"“”]"
UNKNOWN_CHANNEL, MEETINGS = "unknown-channel", "meetings"
#: ISO 843, type 2.
GREEK = dict(zip("αβγδεζηθικλμνξοπρσςτυφχψω", "a v g d e z i th i k l m n x o p r s s t y f ch ps o".split(), strict=True))

VOICED = frozenset("βγδζλμνραεηιουω")

_LETTERS, _DIGRAPH = str.maketrans(GREEK), re.compile("[αεηο]υ|μπ|γ(?=[γξχ])")
_WIDE = re.compile("[\U00010000-\U0010ffff]")
_STRESS, _DIAERESIS = "̀́͂", "̈"


#: Words that a Python worker remembers, and their length at most: texts are made of few.
REMEMBERED, REMEMBERED_LENGTH = 1 << 16, 64


@cache
def _pattern():  # noqa: ANN202
    """One alternative for each rule, in order; they read a word in lower case, decomposed."""
    import regex

    mark = r"\p{M}*+"
    ypsilon = rf"(?:(?![{_STRESS}])\p{{M}})*+υ(?:(?!{_DIAERESIS})\p{{M}})*+(?!{_DIAERESIS})"
    return regex.compile(
        rf"(?P<voiced>[αεη])(?![{_STRESS}]){ypsilon}(?=[{''.join(sorted(VOICED))}])"
        rf"|(?P<voiceless>[αεη]){ypsilon}"
        rf"|(?P<ou>ο){ypsilon}"
        rf"|(?P<b>^μ{mark}π{mark}|μ{mark}π{mark}$)"
        rf"|(?P<mp>μ{mark}π{mark})"
        rf"|(?P<nasal>γ{mark}(?=[γξχ]))"
        rf"|(?P<letter>.){mark}"
    )


@cache
def _greek_words(wide: bool):  # noqa: ANN202
    """Runs of Greek letters and marks, from a letter on; `re` reads a class faster than `regex` a property, if all is of two bytes."""
    import regex

    if wide:
        return regex.compile(r"\p{Script=Greek}[\p{Script=Greek}\p{M}]*")
    narrow = "".join(map(chr, range(1 << 16)))
    greek, marks = ("".join(map(re.escape, regex.findall(f"\\p{{{p}}}", narrow))) for p in ("Script=Greek", "M"))
    return re.compile(f"[{greek}][{greek}{marks}]*")


def _letter(m) -> str:  # noqa: ANN001
    kind = m.lastgroup
    if kind == "voiced":
        return GREEK[m["voiced"]] + "v"
    if kind == "voiceless":
        return GREEK[m["voiceless"]] + "f"
    fixed = {"ou": "ou", "b": "b", "mp": "mp", "nasal": "n"}.get(kind)
    return fixed or GREEK.get(m["letter"], m["letter"])


def _digraph(m) -> str:  # noqa: ANN001
    """Two letters without marks, or γ before another."""
    found = m[0]
    if found == "μπ":
        return "b" if m.start() == 0 or m.end() == len(m.string) else "mp"
    return {"ου": "ou", "γ": "n"}.get(found) or GREEK[found[0]] + ("v" if m.string[m.end() : m.end() + 1] in VOICED else "f")


def _romanized_word(word: str) -> str:
    low = unicodedata.normalize("NFKD", word).lower().replace("ς", "σ")
    if low.isalpha():  # no marks, which are what takes the time
        return _DIGRAPH.sub(_digraph, low).translate(_LETTERS)
    return _pattern().sub(_letter, low)


_remembered = lru_cache(REMEMBERED)(_romanized_word)


def _word(m) -> str:  # noqa: ANN001
    word = m[0]
    return _remembered(word) if len(word) <= REMEMBERED_LENGTH else _romanized_word(word)


def romanize(text: str) -> str:
    """Greek words in Latin letters, anything else as it is."""
    return _greek_words(_WIDE.search(text) is not None).sub(_word, text)


def fold(text: str) -> str:
    """Compatibility decomposition without its marks."""
    return "".join(c for c in unicodedata.normalize("NFKD", text) if unicodedata.category(c)[0] != "M")


@F.pandas_udf(T.StringType())
def _romanized(texts: pd.Series) -> pd.Series:
    return texts.map(romanize, na_action="ignore")


@F.pandas_udf(T.StringType())
def _folded(texts: pd.Series) -> pd.Series:
    return texts.map(fold, na_action="ignore")


def romanize_greek(text: Column) -> Column:
    greek = text.rlike(r"\p{IsGreek}")
    return F.when(greek, _romanized(F.when(greek, text))).otherwise(text)


def kebab_case(text: Column) -> Column:
    """Lower-case Latin letters and digits with hyphens between."""
    other = text.rlike(r"[^\x00-\x7F]")
    out = F.lower(F.when(other, _folded(F.when(other, text))).otherwise(text))
    for letter, plain in TRANSLITERATIONS:
        out = F.replace(out, F.lit(letter), F.lit(plain))
    out = F.regexp_replace(F.regexp_replace(out, QUOTE_MARKS, ""), "[^a-z0-9]+", "-")
    return F.regexp_replace(out, "^-+|-+\\z", "")


def slugify(text: Column) -> Column:
    return kebab_case(romanize_greek(F.coalesce(text, F.lit(""))))


def retention(slug: Column, romanized: Column) -> Column:
    """Letters and digits of the slug out of those of the romanized title; 0 if it has none."""
    had = F.length(F.regexp_replace(romanized, r"[^\p{L}\p{N}]", ""))
    return F.when(had > 0, F.length(F.regexp_replace(slug, "[^a-z0-9]", "")) / had).otherwise(0.0)


def cap(slug: Column) -> Column:
    """At most 120 characters, cut at a hyphen if there is one."""
    cut = F.coalesce(F.nullif(F.regexp_extract(slug, f"^(.{{1,{MOST}}})-", 1), F.lit("")), F.substring(slug, 1, MOST))
    return F.when(F.length(slug) > MOST, F.regexp_replace(cut, "-+\\z", "")).otherwise(slug)


def usable_slug(title: Column) -> Column:
    """The slug of a title, null if it keeps less than half of it."""
    romanized = romanize_greek(F.coalesce(title, F.lit("")))
    slug = kebab_case(romanized)
    return F.when(retention(slug, romanized) >= LEAST_RETAINED, cap(slug))


def transcript_slug(title: Column, fallback: Column) -> Column:
    return F.coalesce(usable_slug(title), fallback)


def channel_folder(handle: Column, channel_id: Column) -> Column:
    """The folder of a channel: its handle, else its id, else a name for all others."""
    empty = F.lit("")
    return F.coalesce(F.nullif(slugify(handle), empty), F.nullif(F.lower(F.coalesce(channel_id, empty)), empty), F.lit(UNKNOWN_CHANNEL))
