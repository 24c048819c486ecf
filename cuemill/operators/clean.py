"""Tracks to clean turns of paragraphs. Everything happens inside a track's row: nothing is shuffled."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuemill.functions.speech import heard
from cuemill.functions.text import choose_notation, classify_track
from cuemill.functions.turns import choose_layout, cut_turns, paragraphs


def word_streams(tracks: DataFrame, raw: str = "raw", key: str | None = "track_key") -> DataFrame:
    """Adds track_kind and _stream: the words without artifacts or rolling repeats, and the turn starts."""
    notation = choose_notation(F.col("track_kind"), F.col(key) if key else F.lit(None).cast("string"))
    return (
        tracks.withColumn("track_kind", classify_track(F.col(raw)))
        .withColumn("_stream", heard(F.col(raw), notation, F.col("track_kind") == "auto"))
    )


def clean_tracks(tracks: DataFrame, layout: str = "auto", raw: str = "raw", key: str | None = "track_key", url: str | None = None) -> DataFrame:
    """Adds track_kind, layout, marks_turns, turns (array<array<string>>: paragraphs) and warnings.

    A layout that is asked for is honoured; prose is one turn. A dialog that was asked for on a
    track without any speaker mark is a single turn, which the warnings say, naming the url.
    """
    whole = F.filter(F.array(F.col("_stream.words")), lambda w: F.size(w) > 0)
    said = F.when(F.col("layout") == "dialog", F.col("_turns")).otherwise(whole)
    single = (F.size(said) == 1) & ~F.col("marks_turns")
    name = F.col(url) if url else F.lit("the track")
    warning = F.array(F.concat(F.lit("A dialog was asked for, but no change of speaker is marked in "), name))
    return (
        word_streams(tracks, raw, key)
        .withColumn("_turns", cut_turns(F.col("_stream.words"), F.col("_stream.turn_starts")))
        .withColumn("layout", choose_layout(layout, F.col("_turns")))
        .withColumn("marks_turns", F.size("_stream.turn_starts") > 0)
        .withColumn("turns", F.transform(said, lambda t: paragraphs(t)))
        .withColumn("warnings", F.when(single & F.lit(layout == "dialog"), warning).otherwise(F.array().cast("array<string>")))
        .drop("_stream", "_turns")
    )
