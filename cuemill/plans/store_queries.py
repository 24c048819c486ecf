"""Queries over the incremental store, with the result of all batches at once in SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuemill.operators import corpus, plan
from cuemill.plans import adapters as G
from cuemill.plans.corpus_queries import BATCH, IDENTITIES, identified
from cuemill.plans.track_queries import query
from cuemill.sources.corpus import read_corpus
from cuemill.sources.files import write_files
from cuemill.sources.shared import fresh_path
from cuemill.sources.tables import IDENTITY, URL, save_bucketed, upsert_bucketed
from cuemill.sources.tracks import read_meetings, read_tracks
from cuemill.streaming.incremental import FILES, read_store, stream_files


def caption_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(batch, video_id, path, modificationTime, length, content): pages' words as rolling captions, in two batches.

    A video's second batch replaces what the first one gave; one video in four is only in the second.
    """
    words = F.filter(F.split(F.lower(F.coalesce("html", F.lit(""))), "[^a-z0-9]+"), lambda w: w != "")
    page, video = F.col("page_id"), F.floor(F.col("page_id") / 5)
    key = F.element_at(F.array(*map(F.lit, G.TRACK_KEYS)), (page % 7 + 1).cast("int"))
    pages = G.table(spark, sf_dir, "pages").withColumn("track", G.rolling_track(F.array_join(words, " "), tagged=True))
    raw = F.encode("track", "UTF-8")
    name = F.concat(F.lit("in/"), page.cast("string"), F.lit("/"), video.cast("string"), F.lit("."), key, F.lit(".vtt"))
    late = (video % 4 == 3) | (page % 5).isin(2, 3)
    return pages.select(
        F.when(late, 1).otherwise(0).alias("batch"), video.cast("string").alias("video_id"), name.alias("path"), F.timestamp_seconds(F.lit(1_600_000_000) + page * 60).alias("modificationTime"), F.octet_length(raw).cast("long").alias("length"), raw.alias("content")
    )


def video_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is known of the videos; four share a title and a channel."""
    n = F.floor(F.col("page_id") / 5)
    group = F.floor(n / 4).cast("string")
    videos = G.table(spark, sf_dir, "pages").select(n.cast("string").alias("video_id"), F.concat(F.lit("Talk "), group).alias("title"), F.concat(F.lit("Channel "), group).alias("channel"), F.concat(F.lit("@c"), (F.floor(n / 4) % 3).cast("string")).alias("uploader_id")).distinct()
    return videos.withColumns({"channel_id": F.lit(""), "duration": F.lit("1:00"), "upload_date": F.lit("20200102")})


@query(
    "incremental",
    """WITH b AS (
  SELECT page_id, page_id // 5 AS video, list_position(['en', 'en-orig', 'en-US', 'en-GB'], ['en', 'en-orig', 'en-US', 'en-GB', 'en-JkeT_87f4cc', 'en-uYU-mmqFLq8', 'fr'][page_id % 7 + 1]) AS place, html AS raw,
    CASE WHEN page_id // 5 % 4 = 3 OR page_id % 5 IN (2, 3) THEN 1 ELSE 0 END AS batch, 'in/' || page_id || '/' AS folder FROM pages),
o AS (SELECT *, row_number() OVER (PARTITION BY video ORDER BY batch DESC, coalesce(place, 5), folder) AS n FROM b),
w AS (SELECT page_id, video, list_filter(string_split_regex(lower(coalesce(raw, '')), '[^a-z0-9]+'), lambda x: x <> '') AS w FROM o WHERE n = 1),
d AS (SELECT *, array_to_string(list_transform(range(len(w)), lambda i: 'w' || i || '_' || w[i + 1]), ' ') AS body FROM w)
SELECT 'c' || video // 4 % 3 AS channel_folder, 'talk-' || video // 4 || CASE WHEN video % 4 = 0 THEN '' ELSE '-' || video END || '.md' AS filename, 'https://www.youtube.com/watch?v=' || video AS identity,
  md5('---' || chr(10) || 'title: "Talk ' || video // 4 || '"' || chr(10) || 'url: https://www.youtube.com/watch?v=' || video || chr(10) || 'channel: "Channel ' || video // 4 || '"' || chr(10) || 'duration: "1:00"' || chr(10) || 'upload_date: 2020-01-02' || chr(10)
    || 'fetched: ' || strftime(make_timestamp((1600000000 + page_id * 60) * 1000000), '%Y-%m-%dT%H:%M:%SZ') || chr(10) || 'subtitles: auto' || chr(10) || 'layout: prose' || chr(10) || '---' || chr(10) || chr(10) || body || chr(10)) AS contents_md5
FROM d""",
)
def incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two batches of caption files through the stream into a store, the second partly over the first."""
    source, store, checkpoint = (fresh_path(spark, name) for name in ("captions", "store", "progress"))
    files, metadata = caption_files(spark, sf_dir), video_metadata(spark, sf_dir)
    for batch in (0, 1):
        files.where(F.col("batch") == batch).select("path", "modificationTime", "length", "content").write.mode("append").parquet(source)
        stream = spark.readStream.schema(FILES).option("maxFilesPerTrigger", 1_000_000).parquet(source)
        stream_files(stream, store, checkpoint, metadata).awaitTermination()
    return read_store(spark, store).select("channel_folder", "filename", "identity", F.md5("contents").alias("contents_md5"))


@query(
    "track_files",
    """SELECT 'v' || page_id AS video_id, ['en', 'en-orig', 'en-US', 'en-GB', 'en-JkeT_87f4cc', 'en-uYU-mmqFLq8', 'fr'][page_id % 7 + 1] AS track_key, ['vtt', 'srt', 'vtt'][page_id % 3 + 1] AS ext, octet_length(encode(html)) AS size, md5(html) AS raw_md5
FROM pages WHERE page_id % 9 <> 0 AND html <> ''""",
)
def track_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as caption files in folders, written and read back; every ninth file is empty and no track."""
    page, folder = F.col("page_id"), fresh_path(spark, "tracks")
    key, ext = F.element_at(F.array(*map(F.lit, G.TRACK_KEYS)), (page % 7 + 1).cast("int")), F.element_at(F.array(F.lit("vtt"), F.lit("srt"), F.lit("vtt")), (page % 3 + 1).cast("int"))
    relative = F.concat(F.lit("d"), (page % 4).cast("string"), F.lit("/v"), page.cast("string"), F.lit("."), key, F.lit("."), ext)
    write_files(G.table(spark, sf_dir, "pages").select(relative.alias("relative"), F.when(page % 9 == 0, "").otherwise(F.coalesce("html", F.lit(""))).alias("content")), folder)
    return read_tracks(spark, folder).select("video_id", "track_key", "ext", "size", F.md5("raw").alias("raw_md5"))


@query("meeting_files", "SELECT 'Sync ' || doc_id || ' + 50%' AS title, octet_length(encode(coalesce(text, ''))) AS size, md5(coalesce(text, '')) AS raw_md5, coalesce(text, '') = '' AS empty FROM documents")
def meeting_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as exports of meetings, written and read back; empty ones are meetings too."""
    folder = fresh_path(spark, "meetings")
    name = F.concat(F.lit("Sync "), F.col("doc_id").cast("string"), F.lit(" + 50%"), F.when(F.col("doc_id") % 2 == 0, ".vtt").otherwise(".VTT"))
    write_files(G.table(spark, sf_dir, "documents").select(name.alias("relative"), F.coalesce("text", F.lit("")).alias("content")), folder)
    return read_meetings(spark, folder).select("title", F.octet_length("raw").cast("long").alias("size"), F.md5("raw").alias("raw_md5"), (F.col("raw") == "").alias("empty"))


@query(
    "corpus_files",
    """SELECT CASE page_id % 11 WHEN 2 THEN 'p' || page_id || '.MD' ELSE 'channel ' || page_id % 6 || '/p' || page_id || '.md' END AS path, md5(coalesce(html, '')) AS text_md5 FROM pages WHERE page_id % 11 > 1""",
)
def corpus_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as the files of a corpus, written and read back; those too deep, or of another kind, are none of it."""
    page, folder = F.col("page_id"), fresh_path(spark, "corpus")
    n, kind = page.cast("string"), page % 11
    name = F.when(kind == 2, F.concat(F.lit("p"), n, F.lit(".MD"))).when(kind == 0, F.concat(F.lit("a/b/p"), n, F.lit(".md"))).when(kind == 1, F.concat(F.lit("a/p"), n, F.lit(".txt"))).otherwise(F.concat(F.lit("channel "), (page % 6).cast("string"), F.lit("/p"), n, F.lit(".md")))
    write_files(G.table(spark, sf_dir, "pages").select(name.alias("relative"), F.coalesce("html", F.lit("")).alias("content")), folder)
    return read_corpus(spark, folder).select("path", F.md5("text").alias("text_md5"))


def _table(name: str) -> str:
    return f"{name}_{uuid.uuid4().hex}"


@query(
    "bucketed_upsert",
    f"""WITH {IDENTITIES}, a AS (SELECT v.page_id, v.path, identity_kind, identity FROM v LEFT JOIN i ON v.page_id = i.page_id),
o AS (SELECT * FROM a WHERE page_id % 4 <> 1), n AS (SELECT page_id, CASE WHEN page_id % 8 = 5 AND kind = 5 THEN 'channel-' || (page_id - 4) % 6 || '/p' || page_id - 4 || '.md' ELSE path END AS path, identity_kind, identity FROM a JOIN v USING (page_id, path) WHERE page_id % 4 = 1 AND identity IS NOT NULL)
SELECT page_id, path, identity_kind, identity FROM n
UNION ALL SELECT page_id, path, identity_kind, identity FROM o WHERE path NOT IN (SELECT path FROM n) AND NOT EXISTS (SELECT 1 FROM n WHERE n.identity_kind = o.identity_kind AND n.identity = o.identity)""",
)
def bucketed_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Upsert into a table in buckets by identity; some incoming transcripts take the names of files without one."""
    files = identified(spark, sf_dir, corpus.with_frontmatter(G.corpus_files(spark, sf_dir)).where("frontmatter.is_transcript").drop("frontmatter"))
    path = F.when((F.col("page_id") % 4 == 1) & (F.col("page_id") % 8 == 5) & (F.col("page_id") % 10 == 5), F.concat(F.lit("channel-"), ((F.col("page_id") - 4) % 6).cast("string"), F.lit("/p"), (F.col("page_id") - 4).cast("string"), F.lit(".md"))).otherwise(F.col("path"))
    rows = files.withColumn("path", path).select("page_id", F.regexp_replace("path", "[^/]*$", "").alias("channel_folder"), F.substring_index("path", "/", -1).alias("filename"), *IDENTITY)
    save_bucketed(rows.where("page_id % 4 != 1"), table := _table("stored"), IDENTITY, 8)
    done = upsert_bucketed(spark.table(table), rows.where("page_id % 4 = 1 and identity_kind is not null"), 8)
    return done.select("page_id", F.concat("channel_folder", "filename").alias("path"), *IDENTITY)


@query("bucketed_plan", BATCH + " SELECT pos, url FROM e WHERE url NOT IN (SELECT url FROM s)")
def bucketed_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of a batch after the urls of the corpus, which lie in a table in buckets by url."""
    page = F.col("page_id")
    expanded = G.table(spark, sf_dir, "pages").select(page.alias("pos"), F.concat(F.lit("https://www.youtube.com/watch?v=v"), F.floor(page / 3).cast("string")).alias("url"))
    save_bucketed(corpus.scan_urls(G.corpus_files(spark, sf_dir)), table := _table("urls"), URL, 8)
    return plan.plan_batch(expanded, spark.table(table))[0]
