"""Licence scans by canonical digests, in DataFrame functions.

Lines that open with a copyright notice are dropped, the text is put in lower case, punctuation and
white space become single spaces, and equivalent spellings are made one. Wrapped prose that happens to
open a line with 'copyright' or '(c)' is no notice: a sign, a year or a name must follow. The SHA-256 of the result is
joined to those of the known licences. Two kinds of entire texts are looked up: the document, and
each of its lines, where one-line notices stand.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cuemill.llm.license_texts import KNOWN, SPELLINGS

#: Licences that are broadcast; a longer table is joined by shuffling.
MOST_BROADCAST = 100_000

_YEAR = r"(?:19|20)\d\d\b"
#: What follows 'copyright' in prose.
_PROSE = r"(?i:holders?|owners?|notices?|licen[cs]es?|laws?|acts?|treat(?:y|ies)|statements?|rights?|interests?|protection|infringements?|permissions?|and|or|in|on|of|to|is|as|for|under|with)\b"
_NOTICES = [
    rf"(?i:copyright)[^\p{{L}}\p{{N}}\n]*(?:\((?i:c)\)|©|&copy;|{_YEAR}|[\[<{{](?i:year|yyyy))",
    rf"(?i:copyright)[ \t]+(?!{_PROSE})[^\n]*\b{_YEAR}",
    rf"(?:Copyright|COPYRIGHT)[ \t]+(?!{_PROSE})(?:(?i:by|the)[ \t]+)*\p{{Lu}}(?=[^\n]*\p{{Ll}})",
    rf"\((?i:c)\)[ \t]*(?:(?i:copyright)[ \t]*)?(?:©|{_YEAR})",
    # Items of a list open with '(c)' too: in a name, all words are capitalised.
    r"\((?i:c)\)[ \t]*(?=[^\n]*\p{Ll})(?:(?:\p{Lu}[^\s]*|&|and|by|the|of|contributors|authors|(?i:all rights reserved)\.?)[ \t\r]*)+(?=\n|\z)",
    r"©",
    r"(?i:all rights reserved)",
]
COPYRIGHT_LINE = rf"(^|\n)[ \t]*(?:{'|'.join(_NOTICES)})[^\n]*"
NOT_WORD = r"[^\p{L}\p{N}\n]+"


def canonical_lines(text: Column) -> Column:
    """The canonical text, with its line ends."""
    out = F.regexp_replace(F.lower(F.regexp_replace(text, COPYRIGHT_LINE, "$1")), NOT_WORD, " ")
    for spelling, usual in SPELLINGS:
        out = F.replace(out, F.lit(spelling), F.lit(usual))
    return out


def canonical(lines: Column) -> Column:
    """The canonical text in one line."""
    return F.trim(F.regexp_replace(lines, r"[ \n]+", " "))


def known_licenses(spark: SparkSession) -> DataFrame:
    """(license_id, text) of the built-in table."""
    rows = F.array(*[F.struct(F.lit(name).alias("license_id"), F.lit(text).alias("text")) for name, text in KNOWN])
    return spark.range(1).select(F.inline(rows))


def scan(docs: DataFrame, known: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text_digest, license_id, notices) for every row.

    license_id is that of a known licence whose text is the whole document (the smallest, if several
    have one text; null if none has), notices those of the document's lines, sorted and comma-joined.
    A null text is empty; empty texts and lines match nothing. Repeated rows each give a row, an
    empty table none. Columns other than the two named are ignored.
    """
    names = known.select("license_id", F.sha2(canonical(canonical_lines(F.col("text"))).cast("binary"), 256).alias("known"))
    names = names.where(F.col("known") != F.sha2(F.lit("").cast("binary"), 256)).groupBy("known").agg(F.min("license_id").alias("license_id"))
    if names.count() <= MOST_BROADCAST:
        names = F.broadcast(names)
    text = F.coalesce(docs[text_col], F.lit(""))
    rows = docs.select(docs[id_col].alias("doc_id"), F.xxhash64(text).alias("twin"), canonical_lines(text).alias("lines"))
    whole = F.array(F.struct(F.lit(True).alias("whole"), canonical(F.col("lines")).alias("unit")))
    each = F.transform(F.split(F.col("lines"), "\n"), lambda x: F.struct(F.lit(False).alias("whole"), F.trim(x).alias("unit")))
    units = rows.select("doc_id", "twin", F.explode(F.concat(whole, each)).alias("u")).select("doc_id", "twin", "u.whole", "u.unit").where("whole or unit != ''")
    units = units.select("doc_id", "twin", "whole", F.sha2(F.col("unit").cast("binary"), 256).alias("digest"))
    found = units.join(names, units.digest == names.known, "left").where("whole or license_id is not null")
    merged = found.groupBy("doc_id", "twin").agg(
        F.max(F.when(F.col("whole"), F.col("digest"))).alias("text_digest"),
        F.max(F.when(F.col("whole"), F.col("license_id"))).alias("license_id"),
        F.array_join(F.sort_array(F.collect_set(F.when(~F.col("whole"), F.col("license_id")))), ",").alias("notices"),
        F.count_if("whole").alias("copies"),
    )
    return merged.select("doc_id", "text_digest", "license_id", "notices", F.explode(F.sequence(F.lit(1), "copies")).alias("copy")).drop("copy")
