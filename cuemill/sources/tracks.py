"""Caption files, metadata and listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cuemill.functions.text import track_key, trim, video_id
from cuemill.sources.files import read_files

METADATA = (
    "id string, title string, channel string, duration_string string, upload_date string, uploader_id string, channel_id string, "
    "description string, uploader string, display_id string, extractor_key string, webpage_url string, playlist_index int"
)
#: Names of the fields of METADATA, as they are called here.
_RENAMED = {"id": "media_id", "duration_string": "duration"}
LISTED = "id string, playlist_index int"


def file_name(path: Column) -> Column:
    return F.url_decode(F.regexp_replace(F.substring_index(path, "/", -1), r"\+", "%2B"))


def read_tracks(spark: SparkSession, path: str) -> DataFrame:
    """(video_id, track_key, ext, path, size, raw) of every file under the path that is not empty."""
    name = file_name(F.col("path"))
    files = read_files(spark, path).where("length > 0")
    return files.select(
        video_id(name).alias("video_id"), track_key(name).alias("track_key"), F.substring_index(name, ".", -1).alias("ext"), "path", F.col("length").alias("size"), F.decode("content", "UTF-8").alias("raw")
    )


def read_meetings(spark: SparkSession, path: str) -> DataFrame:
    """(file_name, title, modified_at, raw) of exported meetings; an empty export is a meeting without cues."""
    name = file_name(F.col("path"))
    files = read_files(spark, path, "*.vtt")
    return files.select(name.alias("file_name"), F.regexp_replace(name, r"(?i)\.vtt\z", "").alias("title"), F.col("modificationTime").alias("modified_at"), F.decode("content", "UTF-8").alias("raw"))


def parse_metadata(stdout: Column) -> Column:
    """The fields of the last line that opens a JSON object; null if there is none or it cannot be read.

    Missing texts are empty, a missing playlist_index is null.
    """
    lines = F.filter(F.transform(F.split(stdout, r"\r?\n"), trim), lambda x: x.startswith("{"))
    last = F.when(F.size(lines) > 0, F.element_at(lines, -1))
    read = F.from_json(last, METADATA + ", _broken string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_broken"})
    fields = [x.split() for x in METADATA.split(", ")]
    values = [(read[n] if kind == "int" else F.coalesce(read[n], F.lit(""))).alias(_RENAMED.get(n, n)) for n, kind in fields]
    return F.when(read.isNotNull() & read["_broken"].isNull(), F.struct(*values))


def parse_listing(listings: DataFrame, post: str = "post_id", stdout: str = "stdout") -> DataFrame:
    """(post_id, position, media_id, rank): a post's videos.

    Lines that are no JSON, or name no video, are left out. A single entry without an index is the
    first; among several, one without an index has no rank and is left out.
    """
    lines = listings.select(F.col(post).alias("post_id"), F.posexplode(F.split(F.coalesce(F.col(stdout), F.lit("")), r"\r?\n")).alias("position", "line"))
    read = lines.where(trim(F.col("line")).startswith("{")).select("post_id", "position", F.from_json(trim(F.col("line")), LISTED).alias("j"))
    named = read.where("coalesce(j.id, '') != ''").select("post_id", "position", F.col("j.id").alias("media_id"), F.col("j.playlist_index").alias("index"))
    counted = named.join(named.groupBy("post_id").agg(F.count(F.lit(1)).alias("entries")), "post_id")
    rank = F.when(F.col("entries") == 1, F.coalesce("index", F.lit(1))).otherwise(F.nullif("index", F.lit(0)))
    return counted.select("post_id", "position", "media_id", rank.alias("rank")).where("rank is not null")
