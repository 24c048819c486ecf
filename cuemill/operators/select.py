"""Which track of a video is used. Rank on keys alone; join the winner's text back by path."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cuemill.functions.text import is_named_track

#: Fixed values.
ENGLISH = ["en", "en-orig", "en-US", "en-GB"]


def _rank(kind: Column, key: Column, name: Column) -> Column:
    """Manual first, then the order of English variants with all else after them, then `.vtt`."""
    variant = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, ENGLISH)), key), F.lit(0)), F.lit(len(ENGLISH) + 1))
    return F.struct(F.when(kind == "manual", 0).otherwise(1).alias("kind"), variant.cast("int").alias("variant"), F.when(F.lower(name).endswith(".vtt"), 0).otherwise(1).alias("extension"))


def rank_tracks(tracks: DataFrame) -> DataFrame:
    """Adds rank, from 1, to tracks (video_id, track_kind, track_key, path)."""
    order = _rank(F.col("track_kind"), F.col("track_key"), F.col("path"))
    return tracks.withColumn("rank", F.row_number().over(Window.partitionBy("video_id").orderBy(order, "path")))


def best_track(tracks: DataFrame) -> DataFrame:
    """(video_id, path, track_kind, track_key): the first in rank, found without a sort."""
    order = F.struct(_rank(F.col("track_kind"), F.col("track_key"), F.col("path")), "path")
    best = tracks.groupBy("video_id").agg(F.min_by(F.struct("path", "track_kind", "track_key"), order).alias("best"))
    return best.select("video_id", "best.path", "best.track_kind", "best.track_key")


def passed_over(tracks: DataFrame) -> DataFrame:
    """(video_id, passed_over array<string>): tracks that lost and might have been wanted, best first, as `kind key`."""
    lost = rank_tracks(tracks).where((F.col("rank") > 1) & ((F.col("track_kind") == "manual") | is_named_track(F.col("track_key"))))
    said = F.concat_ws(" ", "track_kind", "track_key")
    listed = lost.groupBy("video_id").agg(F.sort_array(F.collect_list(F.struct("rank", said.alias("said")))).alias("l"))
    return listed.select("video_id", F.transform("l", lambda x: x["said"]).alias("passed_over"))


def accept_language(key: Column, lang: str = "en") -> Column:
    """English takes its variants and named English tracks; any other language only itself."""
    return key.isin(*ENGLISH) | key.rlike(r"^en-[A-Za-z0-9_-]{11}\z") if lang == "en" else key == lang
