"""Caption-like input made of the test tables inside Spark, by rules that SQL can repeat."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cuemill.functions.render import render_frontmatter
from cuemill.functions.rolling import LINE_MS, LINE_WORDS, rolling_track  # noqa: F401

TRACK_KEYS = ["en", "en-orig", "en-US", "en-GB", "en-JkeT_87f4cc", "en-uYU-mmqFLq8", "fr"]
NAMED_KEY = "en-JkeT_87f4cc"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda w: w != "")


def clock(ms: Column) -> Column:
    part = lambda n, most: F.floor(ms / n) % most
    return F.format_string("%02d:%02d:%02d.%03d", F.floor(ms / 3_600_000), part(60_000, 60), part(1000, 60), (ms % 1000).cast("long"))


def timing(start: Column, end: Column) -> Column:
    return F.concat(clock(start), F.lit(" --> "), clock(end))


#: What a caption would take for markup, events or white space.
MARKUP = r"[\[\]<>&]|[^\p{L}\p{M}\p{N}\p{P}\p{S}\s]"


def told_apart(words: Column, encoded: Column) -> Column:
    """Words of which no two are alike: their places go before them. Where encoded is true a caption can hold any words."""
    tag = lambda w, k: F.concat(F.lit("w"), k.cast("string"), F.lit("_"), w)
    return F.when(encoded, F.transform(words, lambda w, k: tag(F.url_encode(w), k))).otherwise(F.transform(words, tag))


def as_said(words: Column, encoded: Column) -> Column:
    """The words that told_apart was given."""
    said = lambda w: F.substr(w, F.instr(w, F.lit("_")) + 1)
    return F.when(encoded, F.transform(words, lambda w: F.url_decode(said(w)))).otherwise(F.transform(words, said))


def auto_tracks(spark: SparkSession, sf_dir: str, tagged: bool = True) -> DataFrame:
    """(doc_id, track_key, raw): documents as auto tracks; tagged words are each other's unlike."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").repartition(spark.sparkContext.defaultParallelism, "doc_id")  # the test tables are single files
    return docs.select("doc_id", F.lit("en").alias("track_key"), rolling_track(F.col("text"), tagged).alias("raw"))


def manual_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, track_key, raw): a cue for each line; a credit comes first, last or second by doc_id."""
    docs = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", "text").repartition(spark.sparkContext.defaultParallelism, "doc_id")
    lines = F.filter(F.split("text", "\n"), lambda x: F.trim(x) != "")
    kind = F.col("doc_id") % 3
    credit = F.array(F.lit("Transcriber: Some One"))
    second = F.concat(F.slice("lines", 1, 1), F.when(F.size("lines") > 1, credit).otherwise(F.array().cast("array<string>")), F.slice("lines", 2, 1_000_000_000))
    placed = F.when(kind == 0, F.concat(credit, "lines")).when(kind == 1, F.concat("lines", credit)).otherwise(second)
    cue = lambda x, i: F.concat(timing(i.cast("long") * 3000, i.cast("long") * 3000 + 2500), F.lit("\n"), x)
    return docs.withColumn("lines", lines).select("doc_id", F.lit("en").alias("track_key"), F.concat(F.lit("WEBVTT\n\n"), F.array_join(F.transform(placed, cue), "\n\n")).alias("raw"))


def by_conversation(turns: DataFrame, block: Column) -> DataFrame:
    rows = turns.select("conv_id", "order", block.alias("block")).groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("order", "block"))).alias("b"))
    return rows.select("conv_id", F.concat(F.lit("WEBVTT\n\n"), F.array_join(F.transform("b", lambda x: x["block"]), "\n\n")).alias("raw"))


def conversation_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(conv_id, track_key, raw): a cue for each turn, opened by `>>`; every seventh is followed by one that is nothing but music."""
    turns = table(spark, sf_dir, "conversations")
    said = F.regexp_replace(F.coalesce("text", F.lit("")), r"\s+", " ")
    cues = F.array(said, F.when(F.col("turn") % 7 == 6, F.lit("[music]")))
    rows = turns.select("conv_id", "turn", F.posexplode(cues).alias("k", "said")).where("said is not null").withColumn("order", F.struct("turn", "k"))
    start = F.col("turn") * 5000 + F.col("k") * 4000
    return by_conversation(rows, F.concat(timing(start, start + F.when(F.col("k") == 0, 4000).otherwise(500)), F.lit("\n&gt;&gt; "), "said")).withColumn("track_key", F.lit(NAMED_KEY))


def meeting_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(conv_id, raw): turns as utterances whose lines are parts, all first lines before all second ones."""
    lines = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("line", "said"))
    lines = lines.withColumn("order", F.struct("line", "turn"))
    voiced = F.when(F.col("role") == "system", F.col("said")).otherwise(F.concat(F.lit("<v "), "role", F.lit(">"), "said", F.lit("</v>")))
    start = F.col("turn") * 1000 + F.col("line") * 100
    block = F.concat(F.lit("c"), F.col("conv_id").cast("string"), F.lit("/"), F.col("turn").cast("string"), F.lit("-"), F.col("line").cast("string"), F.lit("\n"), timing(start, start + 700), F.lit("\n"), voiced)
    return by_conversation(lines, block)


def page_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(video_id, track_key, track_kind, path, raw): pages as tracks of some videos."""
    page = F.col("page_id")
    key = F.element_at(F.array(*map(F.lit, TRACK_KEYS)), (page % 7 + 1).cast("int"))
    video = F.floor(page / 5)
    path = F.concat(video.cast("string"), F.lit("."), key, F.lit("."), F.element_at(F.array(F.lit("vtt"), F.lit("srt"), F.lit("vtt")), (page % 3 + 1).cast("int")))
    return table(spark, sf_dir, "pages").select(video.alias("video_id"), key.alias("track_key"), F.when(page % 2 == 0, "auto").otherwise("manual").alias("track_kind"), F.concat(path, F.lit("?"), page.cast("string")).alias("path"), F.col("html").alias("raw"))


def title_of(html: Column) -> Column:
    return F.regexp_extract(html, "<title>([^<]*)</title>", 1)


def corpus_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page_id, path, text): pages as transcript files, some of them broken in one way or another by page_id."""
    page = F.col("page_id")
    n = page.cast("string")
    folder = F.when(page % 10 == 7, "").when(page % 10 == 8, "meetings/").otherwise(F.concat(F.lit("channel-"), (page % 6).cast("string"), F.lit("/")))
    url = F.when(page % 10 == 8, F.lit(None)).otherwise(F.concat(F.lit("https://www.youtube.com/watch?v=v"), F.floor(page / 2).cast("string")))
    date = F.date_format(F.date_add(F.lit("2020-01-01"), (page % 700).cast("int")), "yyyyMMdd")
    block = render_frontmatter(
        title_of(F.col("html")), url, F.concat(F.lit("Channel \\ \""), (page % 6).cast("string"), F.lit('"')), F.when(page % 10 != 8, F.concat((page % 60).cast("string"), F.lit(":07"))), date,
        F.timestamp_seconds(F.lit(1_600_000_000) + page * 60), F.when(page % 2 == 0, "auto").otherwise("manual"), F.when(page % 3 == 0, "dialog").otherwise("prose"),
    )
    whole = F.concat(block, F.lit("\n\n"), F.coalesce("html", F.lit("")), F.lit("\n"))
    kind = page % 10
    text = (
        F.when(kind == 0, F.concat(F.lit("# No transcript "), n))
        .when(kind == 1, F.regexp_replace(whole, "\n---\n", "\n"))
        .when(kind == 2, F.regexp_replace(whole, "\nchannel: [^\n]*", ""))
        .when(kind == 3, F.concat(F.lit("﻿"), F.replace(whole, F.lit("\n"), F.lit("\r\n"))))
        .when(kind == 4, F.regexp_replace(whole, "^---\n", "---\n??\n"))
        .otherwise(whole)
    )
    return table(spark, sf_dir, "pages").select("page_id", F.concat(folder, F.lit("p"), n, F.lit(".md")).alias("path"), text.alias("text"))


def outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(event_id, batch, exit_code, has_track, stderr, extractor_key, uploader_id, display_id) by the type of an event."""
    event, kind = F.col("event_id"), F.col("event_type")
    return table(spark, sf_dir, "events").select(
        "event_id",
        F.col("user_id").alias("batch"),
        F.when(kind.isin("click", "view"), 0).otherwise(1).alias("exit_code"),
        (event % 3 != 0).alias("has_track"),
        F.when(event % 5 == 0, "WARNING: Unable to download video subtitles for 'en': HTTP Error 429: Too Many Requests")
        .when(event % 5 == 1, "x\nERROR: [generic] no")
        .when(event % 5 == 2, "ERROR: [twitter] 1: No video could be found in this tweet")
        .when(event % 5 == 3, "ERROR: [twitter] 1: Video #3 is unavailable")
        .alias("stderr"),
        F.when(event % 7 == 0, "Generic").otherwise("Twitter").alias("extractor_key"),
        F.when(event % 11 == 0, "").otherwise("someone").alias("uploader_id"),
        event.cast("string").alias("display_id"),
    )


def inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page_id, input): one of the accepted forms of a target, or one of the refused, by page_id."""
    page = F.col("page_id")
    n = page.cast("string")
    vid = F.lpad(n, 11, "v")
    forms = [vid, F.concat(F.lit("@h."), n), F.concat(F.lit("https://youtu.be/"), vid, F.lit("?t=3")), F.concat(F.lit("youtube.com/watch?v=%76"), F.substring(vid, 2, 10), F.lit("&list=PL"), n), F.concat(F.lit("https://www.YouTube.com/shorts/"), vid),
             F.concat(F.lit("https://m.youtube.com/playlist?list=PL%5F"), n), F.concat(F.lit("https://youtube.com/@h"), n), F.concat(F.lit("https://youtube.com/channel/UC"), n, F.lit("/shorts")), F.concat(F.lit("https://mobile.twitter.com/Some/status/"), n, F.lit("/photo/2?s=1")),
             F.concat(F.lit("x.com/i/web/status/"), n), F.concat(F.lit("https://t.co/a"), n), F.concat(F.lit("https://x.com/i/spaces/"), n), F.concat(F.lit("https://example.com/"), n), F.concat(F.lit("dir/m "), n, F.lit(".VTT")), F.concat(F.lit("  "), vid, F.lit("\n"))]
    return table(spark, sf_dir, "pages").select("page_id", F.element_at(F.array(*forms), (page % len(forms) + 1).cast("int")).alias("input"))


def posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page_id, display_id, media_id, title, playlist_index, description, uploader, uploader_id, channel_id): pages as fetched posts."""
    page = F.col("page_id")
    n = page.cast("string")
    return table(spark, sf_dir, "pages").select(
        "page_id",
        F.floor(page / 3).cast("string").alias("display_id"),
        F.concat(F.lit("m"), n).alias("media_id"),
        F.when(page % 4 == 0, "a video").otherwise("a video #1").alias("title"),
        F.when(page % 5 == 0, (page % 3 + 1).cast("int")).alias("playlist_index"),
        F.when(page % 6 == 0, F.col("url")).otherwise(F.concat(F.lit("Look at  this "), n, F.lit("\n"), "url", F.lit(" now"))).alias("description"),
        F.when(page % 7 != 0, F.concat(F.lit("Name "), n)).alias("uploader"),
        F.concat(F.lit("User_"), (page % 9).cast("string")).alias("uploader_id"),
        n.alias("channel_id"),
    )


def listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(post_id, stdout): for each post its videos, every eighth of all under another name, with noise between."""
    page = F.col("page_id")
    line = F.concat(F.lit('{"id": "'), F.when(page % 8 == 0, "other-").otherwise("m"), page.cast("string"), F.lit('", "playlist_index": '), F.when(page % 6 == 1, "null").otherwise((page % 3 + 1).cast("string")), F.lit("}"))
    rows = table(spark, sf_dir, "pages").select(F.floor(page / 3).cast("string").alias("post_id"), F.struct("page_id", line.alias("line")).alias("l"))
    joined = rows.groupBy("post_id").agg(F.sort_array(F.collect_list("l")).alias("l"))
    return joined.select("post_id", F.concat(F.lit("[info] x\n"), F.array_join(F.transform("l", lambda x: x["line"]), "\r\n{broken\n"), F.lit("\n")).alias("stdout"))
