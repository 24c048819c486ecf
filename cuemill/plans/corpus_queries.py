"""Queries over files, tracks to choose from, targets, outcomes and the store, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuemill.functions.slug import channel_folder, usable_slug
from cuemill.operators import analytics, corpus, identity, outcomes, plan, select, store
from cuemill.plans import adapters as G
from cuemill.plans.track_queries import query
from cuemill.operators.ordered import numbered
from cuemill.sources.corpus import write_catalog
from cuemill.sources.files import read_files
from cuemill.sources.shared import fresh_path
from cuemill.sources.tracks import parse_listing, parse_metadata

#: The adapters' page tracks in SQL.
TRACKS = """t AS (SELECT page_id // 5 AS video_id, ['en', 'en-orig', 'en-US', 'en-GB', 'en-JkeT_87f4cc', 'en-uYU-mmqFLq8', 'fr'][page_id % 7 + 1] AS track_key,
  CASE WHEN page_id % 2 = 0 THEN 'auto' ELSE 'manual' END AS track_kind, page_id, html AS raw FROM pages),
k AS (SELECT *, video_id || '.' || track_key || '.' || ['vtt', 'srt', 'vtt'][page_id % 3 + 1] || '?' || page_id AS path,
  track_key IN ('en-JkeT_87f4cc', 'en-uYU-mmqFLq8') AS named, coalesce(list_position(['en', 'en-orig', 'en-US', 'en-GB'], track_key), 5) AS variant FROM t),
r AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY track_kind <> 'manual', variant, NOT ends_with(lower(path), '.vtt'), path) AS rank FROM k)"""


@query("best_track", f"WITH {TRACKS} SELECT video_id, path, track_kind, track_key FROM r WHERE rank = 1")
def best_track(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select.best_track(G.page_tracks(spark, sf_dir))


@query("passed_over", f"WITH {TRACKS} SELECT video_id, string_agg(track_kind || ' ' || track_key, ', ' ORDER BY rank) AS passed_over FROM r WHERE rank > 1 AND (track_kind = 'manual' OR named) GROUP BY video_id")
def passed_over(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select.passed_over(G.page_tracks(spark, sf_dir)).withColumn("passed_over", F.array_join("passed_over", ", "))


@query("rank_tracks", f"WITH {TRACKS} SELECT video_id, path, CAST(rank AS INTEGER) AS rank, track_key <> 'fr' AS english FROM r")
def rank_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select.rank_tracks(G.page_tracks(spark, sf_dir)).select("video_id", "path", "rank", select.accept_language(F.col("track_key")).alias("english"))


@query("key_census", f"WITH {TRACKS} SELECT count(DISTINCT track_key) AS keys, count(DISTINCT CASE WHEN named THEN track_key END) AS named FROM k")
def key_census(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.key_census(G.page_tracks(spark, sf_dir))


@query("merged_key_census", f"WITH {TRACKS} SELECT count(DISTINCT track_key) AS keys, count(DISTINCT CASE WHEN named THEN track_key END) AS named FROM k")
def merged_key_census(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Track keys of batches by kind, each a sketch, and the sketches merged; of few keys they tell the number."""
    return analytics.merged_key_census(analytics.key_sketches(G.page_tracks(spark, sf_dir), "track_kind"))


@query(
    "identical_tracks",
    f"""WITH {TRACKS}, c AS (SELECT video_id, track_key, raw FROM k UNION ALL SELECT video_id, 'copy', raw FROM k WHERE track_key IN ('en', 'fr'))
SELECT video_id, sha256(raw) AS digest, string_agg(DISTINCT track_key, ',' ORDER BY track_key) AS track_keys FROM c GROUP BY video_id, raw HAVING count(*) > 1""",
)
def identical_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Videos' tracks, two kinds of which were copied under another key."""
    tracks = G.page_tracks(spark, sf_dir).select("video_id", "track_key", "raw")
    copies = tracks.where("track_key in ('en', 'fr')").withColumn("track_key", F.lit("copy"))
    return analytics.identical_tracks(tracks.union(copies)).withColumn("track_keys", F.array_join("track_keys", ","))


@query(
    "slugs",
    """WITH t AS (SELECT p_partkey, p_name || ': ' || p_brand || ' ''' || p_type || ''' & ' || repeat(p_name || ' ', p_partkey % 12) AS title FROM part),
s AS (SELECT p_partkey, regexp_replace(regexp_replace(replace(lower(title), '''', ''), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug FROM t)
SELECT p_partkey, CASE WHEN length(slug) <= 120 THEN slug ELSE regexp_extract(slug, '^(.{1,120})-', 1) END AS slug FROM s""",
)
def slugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    title = F.concat("p_name", F.lit(": "), "p_brand", F.lit(" '"), "p_type", F.lit("' & "), F.repeat(F.concat("p_name", F.lit(" ")), (F.col("p_partkey") % 12).cast("int")))
    return G.table(spark, sf_dir, "part").select("p_partkey", usable_slug(title).alias("slug"))


@query(
    "title_slugs",
    r"""WITH t AS (SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title FROM pages),
s AS (SELECT page_id, title, regexp_replace(regexp_replace(replace(lower(strip_accents(title)), 'ß', 'ss'), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug FROM t),
n AS (SELECT *, length(regexp_replace(title, '[^\p{L}\p{N}]', '', 'g')) AS had, length(regexp_replace(slug, '-', '', 'g')) AS kept FROM s)
SELECT page_id, CASE WHEN had > 0 AND kept * 2 >= had THEN CASE WHEN length(slug) <= 120 THEN slug ELSE regexp_extract(slug, '^(.{1,120})-', 1) END END AS slug FROM n""",
)
def title_slugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.table(spark, sf_dir, "pages").select("page_id", usable_slug(G.title_of(F.col("html"))).alias("slug"))


@query(
    "channel_folders",
    """SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 AND c_custkey % 2 = 0 THEN 'unknown-channel' WHEN c_custkey % 5 = 0 THEN lower('UC' || c_mktsegment)
  ELSE regexp_replace(lower(replace(c_name, '#', '-')), '[^a-z0-9]+', '-', 'g') END AS folder FROM customer""",
)
def channel_folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    five = F.col("c_custkey") % 5 == 0
    handle = F.when(five, F.when(F.col("c_custkey") % 3 == 0, "@")).otherwise(F.concat(F.lit("@"), "c_name"))
    channel = F.when(~five | (F.col("c_custkey") % 2 != 0), F.concat(F.lit("UC"), "c_mktsegment"))
    return G.table(spark, sf_dir, "customer").select("c_custkey", channel_folder(handle, channel).alias("folder"))


#: The adapters' files in SQL: kind says what is wrong with them.
FILES = r"""f AS (SELECT page_id, page_id % 10 AS kind, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title,
  CASE WHEN page_id % 10 = 7 THEN '' WHEN page_id % 10 = 8 THEN 'meetings/' ELSE 'channel-' || page_id % 6 || '/' END || 'p' || page_id || '.md' AS path,
  'https://www.youtube.com/watch?v=v' || page_id // 2 AS url, 'Channel \ "' || page_id % 6 || '"' AS channel, page_id % 60 || ':07' AS duration,
  strftime(DATE '2020-01-01' + CAST(page_id % 700 AS INTEGER), '%Y-%m-%d') AS upload_date, strftime(make_timestamp((1600000000 + page_id * 60) * 1000000), '%Y-%m-%dT%H:%M:%SZ') AS fetched,
  CASE WHEN page_id % 2 = 0 THEN 'auto' ELSE 'manual' END AS subtitles, CASE WHEN page_id % 3 = 0 THEN 'dialog' ELSE 'prose' END AS layout FROM pages),
v AS (SELECT *, CASE kind WHEN 1 THEN 'no line ends its frontmatter' WHEN 2 THEN 'its frontmatter lacks channel' WHEN 4 THEN 'its frontmatter has a line that is neither empty nor a key with a value' END AS error FROM f WHERE kind <> 0)"""


@query(
    "frontmatter_round_trip",
    f"""WITH {FILES} SELECT page_id, error, CASE WHEN kind = 1 THEN NULL ELSE trim(title) END AS title, CASE WHEN kind IN (1, 2) THEN NULL ELSE channel END AS channel, CASE WHEN kind <> 1 THEN fetched END AS fetched,
  CASE WHEN kind = 1 THEN NULL WHEN kind = 8 THEN 6 WHEN kind = 2 THEN 7 ELSE 8 END AS keys FROM v""",
)
def frontmatter_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = corpus.with_frontmatter(G.corpus_files(spark, sf_dir)).where("frontmatter.is_transcript")
    values = F.col("frontmatter.values")
    error = corpus.validate_frontmatter(F.col("path"), F.col("frontmatter"))
    return read.select("page_id", error.alias("error"), F.trim(values["title"]).alias("title"), values["channel"].alias("channel"), values["fetched"].alias("fetched"), F.when(values.isNotNull(), F.size(F.map_keys(values))).alias("keys"))


@query(
    "catalog_rows",
    f"""WITH {FILES} SELECT path, title, CASE WHEN kind = 8 THEN channel ELSE channel END AS channel, CASE WHEN kind = 8 THEN '' ELSE duration END AS duration, upload_date, subtitles FROM v WHERE error IS NULL""",
)
def catalog_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.catalog_rows(G.corpus_files(spark, sf_dir))


@query(
    "catalog_warnings",
    f"""WITH {FILES} SELECT path, 'Left out: ' || path || ', as ' || error AS warning FROM v WHERE error IS NOT NULL
UNION ALL SELECT path, path || ' lies in no channel''s folder' FROM v WHERE error IS NULL AND kind = 7""",
)
def catalog_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.catalog_warnings(G.corpus_files(spark, sf_dir))


CATALOG = f"""WITH {FILES}, r AS (SELECT upload_date, v.title AS title, path, '| [' || replace(v.title, '|', '\\|') || '](' || path || ') | ' || replace(channel, '|', '\\|') || ' | ' || CASE WHEN kind = 8 THEN '' ELSE duration END || ' | ' || upload_date || ' | ' || subtitles || ' |' AS text FROM v WHERE error IS NULL)
SELECT unnest(range(6)) AS line, unnest(['# Transcripts', '', count(*) || ' transcripts, regenerated by cuemill catalog', '', '| Title | Channel | Duration | Uploaded | Subtitles |', '| --- | --- | --- | --- | --- |']) AS text FROM r
UNION ALL SELECT 5 + row_number() OVER (ORDER BY upload_date DESC, title, path), text FROM r"""


@query("render_catalog", CATALOG)
def render_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.render_catalog(G.corpus_files(spark, sf_dir))


@query("written_catalog", CATALOG)
def written_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The catalog as it is written: the lines of its text files, in the order of their names."""
    folder = fresh_path(spark, "catalog")
    write_catalog(corpus.render_catalog(G.corpus_files(spark, sf_dir)), folder)
    parts = read_files(spark, folder, "part-*.txt").where("length > 0")
    lines = parts.select("relative", F.posexplode(F.split(F.regexp_replace(F.decode("content", "UTF-8"), "\n\\z", ""), "\n")).alias("place", "text"))
    return numbered(lines, "relative", "place").select("line", "text")


@query("scan_urls", f"WITH {FILES} SELECT url FROM v WHERE error IS NULL AND kind <> 8")
def scan_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.scan_urls(G.corpus_files(spark, sf_dir))


@query(
    "corpus_rollup",
    f"""WITH {FILES} SELECT CASE WHEN kind = 7 THEN '' WHEN kind = 8 THEN 'meetings' ELSE 'channel-' || page_id % 6 END AS channel_folder, subtitles, layout, count(*) AS transcripts FROM v WHERE error IS NULL GROUP BY ALL""",
)
def corpus_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.corpus_rollup(G.corpus_files(spark, sf_dir))


BATCH = f"WITH {FILES}, e AS (SELECT 'https://www.youtube.com/watch?v=v' || page_id // 3 AS url, min(page_id) AS pos FROM pages GROUP BY 1), s AS (SELECT url FROM v WHERE error IS NULL AND kind <> 8)"


def _batch(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    page = F.col("page_id")
    expanded = G.table(spark, sf_dir, "pages").select(page.alias("pos"), F.concat(F.lit("https://www.youtube.com/watch?v=v"), F.floor(page / 3).cast("string")).alias("url"))
    return plan.plan_batch(expanded, corpus.scan_urls(G.corpus_files(spark, sf_dir)))


@query("plan_to_fetch", BATCH + " SELECT pos, url FROM e WHERE url NOT IN (SELECT url FROM s)")
def plan_to_fetch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W3: what is left of a batch after the corpus is scanned."""
    return _batch(spark, sf_dir)[0]


@query("plan_skipped", BATCH + " SELECT pos, url FROM e WHERE url IN (SELECT url FROM s)")
def plan_skipped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _batch(spark, sf_dir)[1]


OUTCOMES = """o AS (SELECT event_id, user_id AS batch, event_type IN ('click', 'view') AS done, event_id % 3 <> 0 AS has_track, event_id % 5 AS said, event_id % 7 = 0 AS other, event_id % 11 = 0 AS nameless FROM events),
c AS (SELECT *, CASE WHEN done AND has_track THEN NULL WHEN done AND said <> 0 THEN 'no-subtitles' ELSE 'rate-limited' END AS failure,
  CASE WHEN done AND other THEN 'not-an-x-post' WHEN done AND has_track AND nameless THEN 'no-post-identity' WHEN done AND has_track THEN NULL WHEN done AND said <> 0 THEN 'no-subtitles' WHEN done THEN 'rate-limited'
    WHEN said = 1 THEN 'not-an-x-post' WHEN said = 2 THEN 'no-video' WHEN said = 3 THEN 'no-such-video' ELSE 'rate-limited' END AS post_failure FROM o)"""


def _flat(frame: DataFrame) -> DataFrame:
    return frame.select("event_id", "outcome.ok", "outcome.failure", "outcome.retryable")


@query("fetch_outcomes", f"WITH {OUTCOMES} SELECT event_id, failure IS NULL AS ok, failure, coalesce(failure = 'rate-limited', false) AS retryable FROM c")
def fetch_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(outcomes.classify_fetch(G.outcomes(spark, sf_dir)))


@query("post_outcomes", f"WITH {OUTCOMES} SELECT event_id, post_failure IS NULL AS ok, post_failure AS failure, coalesce(post_failure = 'rate-limited', false) AS retryable FROM c")
def post_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(outcomes.classify_post_fetch(G.outcomes(spark, sf_dir)))


def _message_sql(failure: str, text: str) -> str:
    parts = text.replace("'", "''").replace("{url}", "' || url || '").replace("{lang}", "en")
    return f"WHEN '{failure}' THEN '{parts}'"


@query(
    "failure_messages",
    f"""WITH {OUTCOMES}, m AS (SELECT event_id, post_failure AS failure, 'https://x.com/i/status/' || event_id AS url FROM c WHERE post_failure IS NOT NULL)
SELECT event_id, failure, CASE failure {' '.join(_message_sql(*m) for m in outcomes.MESSAGES.items())} END AS message FROM m""",
)
def failure_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _flat(outcomes.classify_post_fetch(G.outcomes(spark, sf_dir))).where("failure is not null")
    url = F.concat(F.lit("https://x.com/i/status/"), F.col("event_id").cast("string"))
    return found.select("event_id", "failure", outcomes.describe_failure(F.col("failure"), url, F.lit("en")).alias("message"))


RESULTS = f"""WITH {OUTCOMES}, b AS (SELECT batch, event_id, CASE WHEN event_id % 13 = 0 THEN 'skipped' WHEN failure IS NULL THEN 'fetched' ELSE 'failed' END AS status, failure FROM c)"""


def _results(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = outcomes.classify_fetch(G.outcomes(spark, sf_dir))
    status = F.when(F.col("event_id") % 13 == 0, "skipped").when(F.col("outcome.ok"), "fetched").otherwise("failed")
    return found.select("batch", F.col("event_id").alias("pos"), F.concat(F.lit("v"), F.col("event_id").cast("string")).alias("url"), status.alias("status"), F.col("outcome.failure").alias("failure"))


@query(
    "batch_summary",
    f"""{RESULTS} SELECT batch, count(*) FILTER (status = 'fetched') AS fetched, count(*) FILTER (status = 'skipped') AS skipped, count(*) FILTER (status = 'failed') AS failed,
  count(*) FILTER (status = 'fetched') || ' fetched, ' || count(*) FILTER (status = 'skipped') || ' skipped, ' || count(*) FILTER (status = 'failed') || ' failed.' AS summary,
  coalesce('Failed:|' || string_agg('  v' || event_id || ' (' || failure || ')', '|' ORDER BY event_id) FILTER (status = 'failed'), '') AS failures FROM b GROUP BY batch""",
)
def batch_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plan.batch_report(_results(spark, sf_dir), separator="|")


@query(
    "batch_failures",
    f"""{RESULTS} SELECT DISTINCT batch, 0 AS line, 'Failed:' AS text FROM b WHERE status = 'failed'
UNION ALL SELECT batch, row_number() OVER (PARTITION BY batch ORDER BY event_id), '  v' || event_id || ' (' || failure || ')' FROM b WHERE status = 'failed'""",
)
def batch_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plan.failure_lines(_results(spark, sf_dir))


IDENTITIES = f"{FILES}, i AS (SELECT page_id, path, fetched, CASE WHEN kind = 8 THEN 'title' ELSE 'url' END AS identity_kind, CASE WHEN kind = 8 THEN title ELSE url END AS identity FROM v WHERE kind <> 1 AND NOT (kind = 8 AND title = ''))"


def identified(spark: SparkSession, sf_dir: str, files: DataFrame | None = None) -> DataFrame:
    files = files if files is not None else G.corpus_files(spark, sf_dir)
    fetched = F.timestamp_seconds(F.lit(1_600_000_000) + F.col("page_id") * 60)
    return store.file_identity(files).withColumn("fetched", fetched)


@query("file_identity", f"WITH {IDENTITIES} SELECT page_id, identity_kind, identity FROM i")
def file_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identified(spark, sf_dir).where("identity_kind is not null").select("page_id", "identity_kind", "identity")


@query("latest_per_identity", f"WITH {IDENTITIES} SELECT identity_kind, identity, page_id FROM (SELECT *, row_number() OVER (PARTITION BY identity_kind, identity ORDER BY page_id DESC) AS n FROM i) WHERE n = 1")
def latest_per_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.latest_per_identity(identified(spark, sf_dir).where("identity_kind is not null"), "page_id").select("identity_kind", "identity", "page_id")


@query(
    "upsert",
    f"""WITH {IDENTITIES}, a AS (SELECT v.page_id, v.path, identity_kind, identity FROM v LEFT JOIN i ON v.page_id = i.page_id), o AS (SELECT * FROM a WHERE page_id % 4 <> 1), n AS (SELECT * FROM a WHERE page_id % 4 = 1 AND identity IS NOT NULL)
SELECT page_id, path, identity_kind, identity FROM n
UNION ALL SELECT page_id, path, identity_kind, identity FROM o WHERE path NOT IN (SELECT path FROM n) AND NOT EXISTS (SELECT 1 FROM n WHERE n.identity_kind = o.identity_kind AND n.identity = o.identity)""",
)
def upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = identified(spark, sf_dir, corpus.with_frontmatter(G.corpus_files(spark, sf_dir)).where("frontmatter.is_transcript").drop("frontmatter")).select("page_id", F.regexp_replace("path", "[^/]*$", "").alias("channel_folder"), F.substring_index("path", "/", -1).alias("filename"), "identity_kind", "identity")
    done = store.upsert(files.where("page_id % 4 != 1"), files.where("page_id % 4 = 1 and identity_kind is not null"))
    return done.select("page_id", F.concat("channel_folder", "filename").alias("path"), "identity_kind", "identity")


@query(
    "filenames",
    """WITH p AS (SELECT page_id, 'f' || page_id % 3 AS channel_folder, 'talk-' || page_id // 6 AS slug, 'u' || page_id AS identity, 'c' || page_id % 2 AS collision_id FROM pages),
n AS (SELECT *, row_number() OVER (PARTITION BY channel_folder, slug ORDER BY page_id) AS k FROM p),
m AS (SELECT *, count(*) FILTER (k > 1) OVER (PARTITION BY channel_folder, slug, collision_id ORDER BY page_id) AS j FROM n)
SELECT channel_folder, identity, CASE WHEN k = 1 THEN slug || '.md' WHEN j = 1 THEN slug || '-' || collision_id || '.md' ELSE slug || '-' || collision_id || '-' || j || '.md' END AS filename FROM m""",
)
def filenames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as transcripts of different videos, six to a slug over three folders."""
    page = F.col("page_id")
    text = lambda prefix, n: F.concat(F.lit(prefix), n.cast("string"))
    incoming = G.table(spark, sf_dir, "pages").select(
        text("f", page % 3).alias("channel_folder"), F.lit("url").alias("identity_kind"), text("u", page).alias("identity"), text("talk-", F.floor(page / 6)).alias("slug"), text("c", page % 2).alias("collision_id"), F.timestamp_seconds(page).alias("fetched")
    )
    existing = spark.createDataFrame([], "channel_folder string, filename string, identity_kind string, identity string")
    return store.resolve_filenames(incoming, existing).select("channel_folder", "identity", "filename")


@query(
    "filenames_beside_files",
    """WITH p AS (SELECT page_id, 'f' || page_id % 3 AS channel_folder, 'talk-' || page_id // 60 AS slug, 'u' || page_id AS identity FROM pages),
n AS (SELECT *, row_number() OVER (PARTITION BY channel_folder, slug ORDER BY page_id) AS r FROM p),
free AS (SELECT *, row_number() OVER (PARTITION BY channel_folder, slug ORDER BY i) AS r FROM (SELECT DISTINCT channel_folder, slug, unnest(range(70)) AS i FROM p) WHERE i NOT IN (0, 3, 4, 9))
SELECT n.channel_folder, identity, CASE i WHEN 1 THEN n.slug || '-c.md' ELSE n.slug || '-c-' || i || '.md' END AS filename FROM n JOIN free f ON n.channel_folder = f.channel_folder AND n.slug = f.slug AND n.r = f.r""",
)
def filenames_beside_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as transcripts of different videos, sixty to a slug, where others have some of the names already and files without an identity have one."""
    page = F.col("page_id")
    text = lambda prefix, n: F.concat(F.lit(prefix), n.cast("string"))
    incoming = G.table(spark, sf_dir, "pages").select(
        text("f", page % 3).alias("channel_folder"), F.lit("url").alias("identity_kind"), text("u", page).alias("identity"), text("talk-", F.floor(page / 60)).alias("slug"), F.lit("c").alias("collision_id"), F.timestamp_seconds(page).alias("fetched")
    )
    name = lambda tail: F.concat("slug", F.lit(tail))
    files = incoming.select("channel_folder", "slug", F.explode(F.array(*[F.struct(name(t).alias("filename"), F.lit(owner).alias("owner")) for t, owner in ((".md", "a"), ("-c-3.md", "b"), ("-c-4.md", "d"), ("-c-5.md", None), ("-c-9.md", "e"), ("-c-02.md", "g"), ("-d-2.md", "h"))])).alias("f")).distinct()
    existing = files.select("channel_folder", "f.filename", F.when(F.col("f.owner").isNotNull(), "url").alias("identity_kind"), F.concat("f.owner", "channel_folder", "slug").alias("identity"))
    return store.resolve_filenames(incoming, existing).select("channel_folder", "identity", "filename")


@query(
    "targets",
    """WITH i AS (SELECT page_id, CAST(page_id AS VARCHAR) AS n, lpad(CAST(page_id AS VARCHAR), 11, 'v') AS vid, page_id % 15 AS form FROM pages)
SELECT page_id, CASE WHEN form IN (0, 2, 3, 4, 14) THEN 'video' WHEN form IN (1, 6, 7) THEN 'channel' WHEN form = 5 THEN 'playlist' WHEN form IN (8, 9, 10) THEN 'post' WHEN form = 13 THEN 'file' END AS kind,
  CASE WHEN form IN (0, 2, 3, 4, 14) THEN 'https://www.youtube.com/watch?v=' || vid WHEN form = 1 THEN 'https://www.youtube.com/@h.' || n || '/videos' WHEN form = 5 THEN 'https://www.youtube.com/playlist?list=PL_' || n
    WHEN form = 6 THEN 'https://www.youtube.com/@h' || n || '/videos' WHEN form = 7 THEN 'https://www.youtube.com/channel/UC' || n || '/shorts' WHEN form = 8 THEN 'https://twitter.com/Some/status/' || n || '/photo/2'
    WHEN form = 9 THEN 'https://x.com/i/web/status/' || n WHEN form = 10 THEN 'https://t.co/a' || n END AS url,
  CASE WHEN form IN (0, 2, 3, 4, 14) THEN vid END AS video_id, CASE WHEN form = 8 THEN 2 WHEN form IN (9, 10) THEN 1 END AS video_number, CASE WHEN form = 13 THEN 'dir/m ' || n || '.VTT' END AS path,
  CASE WHEN form = 11 THEN 'Live talks have no captions that could be read: https://x.com/i/spaces/' || n WHEN form = 12 THEN 'No video, list, channel or post is known by this name: https://example.com/' || n END AS error
FROM i""",
)
def targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plan.parse_targets(G.inputs(spark, sf_dir)).select("page_id", "target.*")


@query(
    "expansion",
    """WITH i AS (SELECT page_id, page_id // 10 AS batch, page_id % 15 AS form, lpad(CAST(page_id AS VARCHAR), 11, 'v') AS vid FROM pages)
SELECT batch, 'https://www.youtube.com/watch?v=' || vid AS url, row_number() OVER (PARTITION BY batch ORDER BY page_id) AS place FROM i WHERE form IN (0, 2, 3, 4, 14)""",
)
def expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inputs as the lines of listings, ten to a listing."""
    rows = G.inputs(spark, sf_dir).select(F.floor(F.col("page_id") / 10).alias("batch"), F.struct("page_id", F.trim(F.regexp_replace("input", r"\s+", " ")).alias("line")).alias("l"))
    listed = rows.groupBy("batch").agg(F.array_join(F.transform(F.sort_array(F.collect_list("l")), lambda x: x["line"]), "\r\n").alias("stdout"))
    read = plan.parse_expansion(listed)
    numbered = read.groupBy("batch").agg(F.sort_array(F.collect_list(F.struct("pos", "url"))).alias("u")).select("batch", F.posexplode("u").alias("k", "v"))
    return numbered.select("batch", "v.url", (F.col("k") + 1).cast("long").alias("place"))


POSTS = """p AS (SELECT page_id, page_id // 3 AS post, page_id % 3 + 1 AS place, CASE WHEN page_id % 5 = 0 THEN page_id % 3 + 1 WHEN page_id % 4 = 0 THEN 1 END AS reported FROM pages),
l AS (SELECT page_id, page_id // 3 AS post, CASE WHEN page_id % 6 <> 1 THEN page_id % 3 + 1 END AS idx, count(*) OVER (PARTITION BY page_id // 3) AS entries FROM pages),
k AS (SELECT page_id, coalesce(idx, CASE WHEN entries = 1 THEN 1 END) AS rank FROM l WHERE page_id % 8 <> 0),
r AS (SELECT p.page_id, post, CAST(coalesce(reported, rank) AS INTEGER) AS rank FROM p LEFT JOIN k ON p.page_id = k.page_id)"""


def _ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identity.rank_in_listing(G.posts(spark, sf_dir), parse_listing(G.listings(spark, sf_dir)))


@query("listing_rank", f"WITH {POSTS} SELECT page_id, rank, CASE WHEN rank IS NULL THEN 'unlisted-video' END AS failure FROM r")
def listing_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ranked(spark, sf_dir).select("page_id", "rank", "failure")


@query(
    "post_identity",
    f"""WITH {POSTS}, s AS (SELECT r.*, CASE WHEN rank > 1 THEN CAST(rank AS VARCHAR) END AS number, r.page_id % 6 = 0 AS silent, 'User_' || r.page_id % 9 AS handle FROM r WHERE rank IS NOT NULL)
SELECT page_id, CASE WHEN silent THEN '@' || handle || ' post ' || post ELSE 'Look at this ' || page_id || ' now' END AS post_title, 'https://x.com/i/status/' || post || coalesce('/video/' || number, '') AS url,
  CASE WHEN page_id % 7 <> 0 THEN 'Name ' || page_id || ' (@' || handle || ')' ELSE '@' || handle END AS post_channel, 'user-' || page_id % 9 AS channel_folder, post || coalesce('-' || number, '') AS collision_id,
  CASE WHEN silent THEN lower(handle) || '-' || post || coalesce('-' || number, '') ELSE 'look-at-this-' || page_id || '-now' END AS slug FROM s""",
)
def post_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = _ranked(spark, sf_dir).where("failure is null").drop("url")
    return identity.post_identity(known).select("page_id", "post_title", "url", "post_channel", "channel_folder", "collision_id", "slug")


@query(
    "video_identity",
    """SELECT c_custkey, 'v' || c_custkey AS collision_id, regexp_replace(lower(c_name), '[^a-z0-9]+', '-', 'g') AS channel_folder,
  CASE WHEN c_custkey % 4 = 0 THEN 'v' || c_custkey ELSE regexp_replace(lower(c_mktsegment || ' ' || c_custkey), '[^a-z0-9]+', '-', 'g') END AS slug FROM customer""",
)
def video_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey").cast("string")
    videos = G.table(spark, sf_dir, "customer").select(
        "c_custkey", F.concat(F.lit("v"), key).alias("video_id"), F.when(F.col("c_custkey") % 4 == 0, "日本語の題").otherwise(F.concat("c_mktsegment", F.lit(" "), key)).alias("title"), F.concat(F.lit("@"), "c_name").alias("uploader_id"), F.lit("UC1").alias("channel_id")
    )
    return identity.video_identity(videos).select("c_custkey", "collision_id", "channel_folder", "slug")


@query(
    "meeting_identity",
    """WITH m AS (SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN '会議' || c_custkey % 10 ELSE c_mktsegment || ' ' || c_custkey END AS title FROM customer)
SELECT c_custkey, title, CASE WHEN c_custkey % 4 <> 0 THEN regexp_replace(lower(title), '[^a-z0-9]+', '-', 'g') END AS slug, substr(sha1(title), 1, 8) AS collision_id, c_custkey % 4 = 0 AS refused FROM m""",
)
def meeting_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    name = F.when(key % 4 == 0, F.concat(F.lit("会議"), (key % 10).cast("string"), F.lit(".vtt"))).otherwise(F.concat("c_mktsegment", F.lit(" "), key.cast("string"), F.lit(".VTT")))
    named = identity.meeting_identity(G.table(spark, sf_dir, "customer").withColumn("file_name", name))
    return named.select("c_custkey", "title", "slug", "collision_id", F.col("error").isNotNull().alias("refused"))


@query(
    "metadata",
    r"""WITH p AS (SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS t FROM pages)
SELECT page_id, page_id % 5 <> 0 AS readable, CASE WHEN page_id % 5 <> 0 THEN t END AS title, CASE WHEN page_id % 5 <> 0 THEN '' END AS channel, CASE WHEN page_id % 5 <> 0 AND page_id % 2 = 0 THEN CAST(page_id % 3 AS INTEGER) END AS playlist_index FROM p""",
)
def metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages' titles as the output of a fetch: the last line that opens an object counts."""
    page = F.col("page_id")
    record = F.to_json(F.struct(G.title_of(F.col("html")).alias("title"), F.when(page % 2 == 0, (page % 3).cast("int")).alias("playlist_index"), F.lit("20200102").alias("upload_date")))
    stdout = F.when(page % 10 == 0, "no object").when(page % 5 == 0, F.concat(record, F.lit("\n{broken"))).otherwise(F.concat(F.lit('{"title": "old"}\r\n  '), record, F.lit("\nend\n")))
    read = G.table(spark, sf_dir, "pages").select("page_id", parse_metadata(stdout).alias("m"))
    return read.select("page_id", F.col("m").isNotNull().alias("readable"), "m.title", "m.channel", "m.playlist_index")
