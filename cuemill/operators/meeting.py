"""Meetings: cue parts put together to utterances, and these to turns of named speakers.

The relational form: one row per credit, in range partitions by meeting and place. Turns are islands
of rows that are found within each part, and stitched between parts: neither a meeting nor its order
is ever one task's. Only the documents of `clean_meetings` are a row each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cuemill.functions.cues import parse_cues
from cuemill.functions.render import render_body, render_contents, render_frontmatter
from cuemill.functions.speech import cue_text, spoken
from cuemill.functions.slug import MEETINGS, usable_slug
from cuemill.functions.text import MEETING_SENTENCE_END, SPACE_INSIDE, collapse, decode_entities, format_duration, let, local_date
from cuemill.functions.turns import paragraphs
from cuemill.operators.ordered import island_numbers, ranged
from cuemill.sources.shared import keep

#: Fixed values.
UTTERANCE_ID = r"^(.+/\d+)-(\d+)\z"
VOICE_OPENS = f"(?i)<v(?:\\.[^{SPACE_INSIDE}>]*)*[{SPACE_INSIDE}]+([^>]*)>"
VOICE_CLOSES = "(?i)</v>"

_FROM, _NAMED = "", ""


def cue_credits(lines: Column) -> Column:
    """array<struct<speaker, text>>: what each voice tag's speaker says, in order, its lines as they are; null outside of tags."""
    text = F.translate(F.array_join(lines, "\n"), _FROM + _NAMED, "")
    marked = F.regexp_replace(F.regexp_replace(text, VOICE_OPENS, f"{_FROM}$1{_NAMED}"), VOICE_CLOSES, _FROM + _NAMED)

    def credit(piece: Column, k: Column) -> Column:
        name = F.nullif(collapse(decode_entities(F.substring_index(piece, _NAMED, 1))), F.lit(""))
        rest = F.when(k == 0, piece).otherwise(F.substring_index(piece, _NAMED, -1))
        return F.struct(F.when(k > 0, name).alias("speaker"), rest.alias("text"))

    return F.transform(F.split(marked, _FROM), credit)


def credits(meetings: DataFrame, meeting: str = "meeting", raw: str = "raw") -> DataFrame:
    """(meeting, utterance_key, part, position, credit_no, speaker, words), a row per credit.

    What has no words has null ones: its cue can be the first of its utterance all the same. A cue
    without an utterance's id is an utterance of its own.
    """
    cues = meetings.select(F.col(meeting).alias("meeting"), F.posexplode(parse_cues(F.col(raw), ids=True)).alias("position", "cue"))
    cue_id = F.coalesce(F.col("cue.id"), F.lit(""))
    key = F.nullif(F.regexp_extract(cue_id, UTTERANCE_ID, 1), F.lit(""))
    part = F.when(key.isNotNull(), F.regexp_extract(cue_id, UTTERANCE_ID, 2).cast("long")).otherwise(0)
    said = cues.select(
        "meeting",
        F.coalesce(key, F.concat(F.lit("cue "), F.col("position").cast("string"))).alias("utterance_key"),
        part.cast("long").alias("part"),
        "position",
        F.posexplode_outer(cue_credits(F.col("cue.lines"))).alias("credit_no", "credit"),
    ).select("meeting", "utterance_key", "part", "position", "credit_no", "credit.speaker", F.explode(F.array(cue_text(F.array(F.split("credit.text", "\n"))))).alias("text"))
    spoken_words = spoken(F.col("text"), F.lit("auto"), F.lit(False))["words"]
    words = said.withColumn("words", spoken_words)
    return words.select("meeting", "utterance_key", "part", "position", "credit_no", "speaker", F.when(F.size("words") > 0, F.col("words")).alias("words"))


def _ordered(found: DataFrame) -> DataFrame:
    """Credits with first_position, the place of their utterance's first cue, in the order of their meetings; a meeting of any size is spread over tasks."""
    first = F.min("position").over(Window.partitionBy("meeting", "utterance_key"))
    return ranged(found.withColumn("first_position", first).where("words is not null"), "meeting", "first_position", "part", "position", "credit_no")


def _joined(found: DataFrame, *by: str) -> DataFrame:
    parts = F.sort_array(F.collect_list(F.struct("first_position", "part", "position", "credit_no", "words")))
    return found.groupBy("meeting", *by).agg(F.flatten(F.transform(parts, lambda p: p["words"])).alias("words"))


def rebuild_utterances(found: DataFrame) -> DataFrame:
    """(meeting, entry_no, utterance_key, speaker, words): an utterance's parts in part order, wherever they stand.

    Utterances come in the order of their first cues. Within one, neighbours of one speaker are one
    entry; those without a speaker too.
    """
    same = (F.col("before.utterance_key") == F.col("utterance_key")) & F.col("before.speaker").eqNullSafe(F.col("speaker"))
    return _joined(island_numbers(_ordered(found), "meeting", ~same, ["utterance_key", "speaker"], "entry_no"), "entry_no", "utterance_key", "speaker")


def meeting_turns(found: DataFrame) -> DataFrame:
    """(meeting, turn_no, speaker, words): neighbouring entries of one named speaker are a turn."""
    before, key = F.col("before.speaker"), F.col("before.utterance_key")
    unnamed = F.col("speaker").isNull() & before.isNull() & (key == F.col("utterance_key"))
    same = F.coalesce(unnamed | (before == F.col("speaker")), F.lit(False))
    return _joined(island_numbers(_ordered(found), "meeting", ~same, ["utterance_key", "speaker"], "turn_no"), "turn_no", "speaker")


def turn_rows(meetings: DataFrame, layout: str = "auto", meeting: str = "meeting", raw: str = "raw") -> DataFrame:
    """(meeting, layout, turn_no, speaker, paragraphs), a row per turn: as `clean_meetings`, and no meeting is ever in one row.

    The layouts are those of turns, auto, meeting and dialog; prose is a meeting's one turn.
    """
    if layout not in ("auto", "meeting", "dialog"):
        raise ValueError(f"turns have no layout {layout!r}")
    turns = keep(meeting_turns(credits(meetings, meeting, raw)), "turns")
    named = turns.where("speaker is not null").select(F.col("meeting").alias("_named")).distinct()
    by_name = F.lit(False) if layout == "dialog" else F.col("_named").isNotNull()
    told = turns.join(named, F.col("meeting").eqNullSafe(F.col("_named")) & F.lit(layout != "dialog"), "left")
    return told.select(
        "meeting",
        F.when(by_name, "meeting").otherwise("dialog").alias("layout"),
        "turn_no",
        F.when(by_name, F.col("speaker")).alias("speaker"),
        F.when(by_name, paragraphs(F.col("words"), MEETING_SENTENCE_END)).otherwise(paragraphs(F.col("words"))).alias("paragraphs"),
    )


def clean_meetings(meetings: DataFrame, layout: str = "auto", meeting: str = "meeting", raw: str = "raw") -> DataFrame:
    """(meeting, layout, duration, turns array<struct<speaker, paragraphs>>), a row per meeting.

    The name of a meeting must be its own. auto and meeting name the speakers if there are any; a
    semicolon ends a sentence in the meeting layout only. No words are lost and none are deduplicated.
    """
    if layout not in ("auto", "meeting", "prose", "dialog"):
        raise ValueError(f"a meeting has no layout {layout!r}")
    turns = meeting_turns(credits(meetings, meeting, raw))
    own = turns.groupBy("meeting").agg(F.sort_array(F.collect_list(F.struct("turn_no", "speaker", "words"))).alias("all_turns"), F.max(F.col("speaker").isNotNull()).alias("named"))
    ends = F.transform(parse_cues(F.col(raw)), lambda c: c["end_ms"])
    base = meetings.select(F.col(meeting).alias("meeting"), F.array_max(ends).alias("last_end"))
    chosen = F.lit(layout) if layout in ("prose", "dialog") else F.when(F.col("named"), "meeting").otherwise("dialog")

    def laid_out(turns: Column) -> Column:
        as_meeting = F.transform(turns, lambda t: F.struct(t["speaker"].alias("speaker"), paragraphs(t["words"], MEETING_SENTENCE_END).alias("paragraphs")))
        as_dialog = F.transform(turns, lambda t: F.struct(F.lit(None).cast("string").alias("speaker"), paragraphs(t["words"]).alias("paragraphs")))
        whole = F.array(F.flatten(F.transform(turns, lambda t: t["words"])))
        as_prose = F.transform(F.filter(whole, lambda w: F.size(w) > 0), lambda w: F.struct(F.lit(None).cast("string").alias("speaker"), paragraphs(w).alias("paragraphs")))
        return F.when(F.col("layout") == "meeting", as_meeting).when(F.col("layout") == "dialog", as_dialog).otherwise(as_prose)

    joined = base.join(own, "meeting", "left").withColumn("layout", chosen)
    empty = F.array().cast("array<struct<turn_no:int,speaker:string,words:array<string>>>")
    return joined.select("meeting", "layout", format_duration(F.col("last_end")).alias("duration"), let(F.coalesce("all_turns", empty), laid_out).alias("turns"))


def meeting_documents(meetings: DataFrame, fetched: Column, layout: str = "auto", meeting: str = "meeting") -> DataFrame:
    """(meeting, filename, channel_folder, collision_id, layout, contents) of meetings (meeting, title, modified_at, raw).

    The date of a meeting is the day it was last changed, in the session's time zone; it has no url
    and no channel. Where the title makes no usable slug, filename is null, and the meeting is not to
    be stored.
    """
    own = meetings.select(F.col(meeting).alias("meeting"), "title", local_date(F.col("modified_at")).alias("date"))
    found = clean_meetings(meetings, layout, meeting).join(own, "meeting")
    none = F.lit(None).cast("string")
    block = render_frontmatter(F.col("title"), none, F.lit(""), F.col("duration"), F.col("date"), fetched, F.lit("auto"), F.col("layout"))
    return found.select(
        "meeting",
        F.concat(usable_slug(F.col("title")), F.lit(".md")).alias("filename"),
        F.lit(MEETINGS).alias("channel_folder"),
        F.substring(F.sha1(F.col("title").cast("binary")), 1, 8).alias("collision_id"),
        "layout",
        render_contents(block, render_body(F.col("turns"), F.col("layout"))).alias("contents"),
    )
