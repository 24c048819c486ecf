"""String functions: white space, tags, entities, words, times, dates and quoting.

White space is Unicode-wide here, and a text's end is its very end: Java's own classes differ in both.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values.
SPACE = r"[\s\x0B\u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF]"
SPACE_INSIDE = SPACE[1:-1]
SPACES = " \t\n\x0b\f\r\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
_RARE = r"\t-\r\u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF"
TIMING = r"(\d{2}:\d{2}:\d{2}[.,]\d{3})" + SPACE + r"*-->" + SPACE + r"*(\d{2}:\d{2}:\d{2}[.,]\d{3})"
AUTO_SIGNAL = r"<c[\s.>]|align:start position:0%"
NAMED_TRACK = r"^[A-Za-z]{2,3}-[A-Za-z0-9_-]{11}\z"
ENTITIES = [("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&#39;", "'"), ("&quot;", '"')]
SENTENCE_END = r"""[.!?]["')\]]?\z"""
MEETING_SENTENCE_END = r"""[.!?;]["')\]]?\z"""


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value worked out once however often it is used."""
    return F.get(F.transform(F.array(value), use), 0)


def trim(text: Column) -> Column:
    """Without white space at the ends."""
    return F.btrim(text, F.lit(SPACES))


def collapse(text: Column) -> Column:
    """Runs of white space as one space, none at the ends. A single space is no match: most texts have nothing to replace."""
    return F.trim(F.regexp_replace(text, f"[{_RARE}][ {_RARE}]*| [ {_RARE}]+", " "))


def strip_tags(text: Column) -> Column:
    """Without anything from `<` to the next `>`."""
    return F.when(text.contains("<"), F.regexp_replace(text, "<[^>]*>", "")).otherwise(text)


def decode_entities(text: Column) -> Column:
    """The five entities, the ampersand first, so that a doubly escaped one is decoded twice."""
    decoded = text
    for entity, plain in ENTITIES:
        decoded = F.replace(decoded, F.lit(entity), F.lit(plain))
    return F.when(text.contains("&"), decoded).otherwise(text)


def clean_line(line: Column) -> Column:
    return collapse(decode_entities(strip_tags(line)))


def clean_lines(text: Column, ends: str) -> Column:
    """clean_line of each line of a text in which the given characters end lines; it is read as a whole, not line by line."""
    rare = _RARE.replace(r"\t-\r", r"\t\x0B\f\r")  # all but the newline

    def tagless(t: Column) -> Column:
        return F.when(t.contains("<"), F.regexp_replace(t, f"<[^>{ends}]*>", "")).otherwise(t)

    spaced = F.regexp_replace(let(let(text, tagless), decode_entities), f"[{rare}][ {rare}]*| [ {rare}]+", " ")
    return F.btrim(F.regexp_replace(spaced, f" ?([{ends}]) ?", "$1"), F.lit(" "))


def to_milliseconds(timestamp: Column) -> Column:
    """`HH:MM:SS.mmm`, or with a comma, as a whole number."""
    part = lambda at, n: F.substring(timestamp, at, n).cast("long")
    return ((part(1, 2) * 60 + part(4, 2)) * 60 + part(7, 2)) * 1000 + part(10, 3)


def classify_track(raw: Column) -> Column:
    """`auto` if the track has a mark that only recognised speech has, else `manual`."""
    return F.when(raw.rlike(AUTO_SIGNAL), "auto").otherwise("manual")


def is_named_track(key: Column) -> Column:
    return F.coalesce(key.rlike(NAMED_TRACK), F.lit(False))


def choose_notation(kind: Column, key: Column) -> Column:
    """Which notation a track is written in: a named track's is auto, whatever its kind."""
    return F.when(is_named_track(key), "auto").otherwise(kind)


def track_key(file_name: Column) -> Column:
    """What is between the first and the last dot of `<id>.<key>.<ext>`."""
    return F.regexp_extract(file_name, r"^[^.]*\.(.*)\.[^.]*\z", 1)


def video_id(file_name: Column) -> Column:
    return F.substring_index(file_name, ".", 1)


def format_upload_date(date: Column) -> Column:
    """`YYYYMMDD` as `YYYY-MM-DD`; anything else trimmed."""
    return F.regexp_replace(trim(F.coalesce(date, F.lit(""))), r"^(\d{4})(\d{2})(\d{2})\z", "$1-$2-$3")


def format_fetched(instant: Column) -> Column:
    """A UTC instant in whole seconds, in a session of any time zone."""
    utc = F.to_utc_timestamp(instant, F.current_timezone())
    return F.date_format(utc, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def local_date(instant: Column) -> Column:
    """`yyyyMMdd` in the session's time zone."""
    return F.date_format(instant, "yyyyMMdd")


def quote_yaml(value: Column) -> Column:
    """Always in double quotes; backslashes are escaped before quotes."""
    escaped = F.replace(F.replace(F.coalesce(value, F.lit("")), F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    return F.concat(F.lit('"'), escaped, F.lit('"'))


def unquote(value: Column) -> Column:
    """The inverse of quote_yaml; text that is not in quotes stays."""
    inner = F.regexp_replace(value.substr(F.lit(2), F.length(value) - 2), r'\\(["\\])', "$1")
    return F.when((F.length(value) >= 2) & value.startswith('"') & value.endswith('"'), inner).otherwise(value)


def format_duration(ms: Column) -> Column:
    """`M:SS`, or `H:MM:SS` from an hour on; half a second rounds up. Null stays null."""
    total = F.round(ms / 1000).cast("long")
    minutes = F.floor(total / 60) % 60
    return F.when(total.isNull(), F.lit(None).cast("string")).when(total >= 3600, F.format_string("%d:%02d:%02d", F.floor(total / 3600), minutes, total % 60)).otherwise(F.format_string("%d:%02d", minutes, total % 60))
