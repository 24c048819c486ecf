"""Queries over rendered documents, Greek titles, repeated words and the transcript sink, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuemill.functions.render import render_body, unnamed
from cuemill.functions.slug import kebab_case, romanize_greek
from cuemill.operators import analytics, meeting
from cuemill.operators.clean import clean_tracks
from cuemill.plans import adapters as G
from cuemill.plans.track_queries import CUTS, DOCS, MEETING, WORDS, query
from cuemill.sources.corpus import write_transcripts
from cuemill.sources.shared import fresh_path

#: Paragraph ends of words w, with those of meetings, and the text of a turn made of them.
SPLIT = f"""CASE WHEN named THEN {CUTS.format(w='w').replace('[.!?]', '[.!?;]')} ELSE {CUTS.format(w='w')} END AS cuts"""
SAID = """array_to_string(list_transform(range(1, len(ends) + 1), lambda k: array_to_string(w[coalesce(ends[k - 1], 0) + 1 : ends[k]], ' ')), chr(10) || chr(10))"""
ENDS = "CASE WHEN len(cuts) > 0 AND cuts[-1] = len(w) THEN cuts ELSE list_append(cuts, len(w)) END AS ends"


@query(
    "meeting_documents",
    f"""WITH {MEETING},
n AS (SELECT conv_id, bool_or(speaker IS NOT NULL) AS named FROM g GROUP BY conv_id),
h AS (SELECT g.conv_id, turn_no, speaker, w, named, {SPLIT} FROM g JOIN n ON g.conv_id = n.conv_id),
q AS (SELECT *, {ENDS} FROM h),
o AS (SELECT conv_id, any_value(named) AS named, string_agg('— ' || CASE WHEN named AND speaker IS NOT NULL THEN '**' || speaker || ':** ' ELSE '' END || {SAID}, chr(10) || chr(10) ORDER BY turn_no) AS body FROM q GROUP BY conv_id),
e AS (SELECT conv_id, (max(turn * 1000 + (len(string_split(coalesce(text, ''), chr(10))) - 1) * 100 + 700) + 500) // 1000 AS s FROM conversations GROUP BY conv_id)
SELECT e.conv_id, 'meeting-' || e.conv_id || '.md' AS filename, substr(sha1('Meeting ' || e.conv_id), 1, 8) AS collision_id,
  md5('---' || chr(10) || 'title: "Meeting ' || e.conv_id || '"' || chr(10) || 'channel: ""' || chr(10)
    || 'duration: "' || CAST(s // 60 AS VARCHAR) || ':' || lpad(CAST(s % 60 AS VARCHAR), 2, '0') || '"' || chr(10) || 'upload_date: ' || strftime(DATE '2021-01-01' + CAST(e.conv_id % 300 AS INTEGER), '%Y-%m-%d') || chr(10)
    || 'fetched: 2020-09-13T12:26:40Z' || chr(10) || 'subtitles: auto' || chr(10) || 'layout: ' || CASE WHEN named THEN 'meeting' ELSE 'dialog' END || chr(10) || '---' || chr(10) || chr(10) || coalesce(body, '') || chr(10)) AS contents_md5
FROM e LEFT JOIN o ON e.conv_id = o.conv_id""",
)
def meeting_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W2 to its end: meetings as documents, with their speakers' names."""
    conv = F.col("conv_id")
    tracks = G.meeting_tracks(spark, sf_dir).select("conv_id", F.concat(F.lit("Meeting "), conv.cast("string")).alias("title"), F.date_add(F.lit("2021-01-01").cast("date"), (conv % 300).cast("int")).cast("timestamp").alias("modified_at"), "raw")
    found = meeting.meeting_documents(tracks, F.timestamp_seconds(F.lit(1_600_000_000)), meeting="conv_id")
    return found.select(F.col("meeting").alias("conv_id"), "filename", "collision_id", F.md5("contents").alias("contents_md5"))


@query(
    "dialog_bodies",
    f"""WITH t AS (SELECT conv_id, turn, {WORDS.format(text='text')} AS w FROM conversations),
h AS (SELECT conv_id, turn, w, {CUTS.format(w='w')} AS cuts FROM t WHERE len(w) > 0), q AS (SELECT *, {ENDS} FROM h),
o AS (SELECT conv_id, string_agg('— ' || {SAID}, chr(10) || chr(10) ORDER BY turn) AS body FROM q GROUP BY conv_id)
SELECT DISTINCT t.conv_id, 'dialog' AS layout, md5(coalesce(body, '')) AS body_md5 FROM t LEFT JOIN o ON t.conv_id = o.conv_id""",
)
def dialog_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Manual tracks with speaker marks as dialogs: each turn opens with a dash."""
    cleaned = clean_tracks(G.conversation_tracks(spark, sf_dir), "dialog")
    return cleaned.select("conv_id", "layout", F.md5(render_body(unnamed(F.col("turns")), F.col("layout"))).alias("body_md5"))


@query("asked_dialogs", f"WITH {DOCS} SELECT doc_id, 'dialog' AS layout, CASE WHEN n > 0 THEN 'A dialog was asked for, but no change of speaker is marked in d' || doc_id ELSE '' END AS warning FROM p")
def asked_dialogs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A dialog that is asked for where no speaker is marked, and the warning of that."""
    tracks = G.auto_tracks(spark, sf_dir).withColumn("url", F.concat(F.lit("d"), F.col("doc_id").cast("string")))
    return clean_tracks(tracks, "dialog", url="url").select("doc_id", "layout", F.array_join("warnings", "\n").alias("warning"))


@query(
    "repeated_runs",
    r"""WITH d AS (SELECT doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[^a-z0-9_]+'), lambda x: x <> '') AS w FROM documents),
e AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 AND len(w) > 5 THEN list_concat(w, w[-6:]) ELSE w END AS w FROM d)
SELECT doc_id, len(list_filter(range(1, len(w) - 10), lambda k: w[k : k + 5] = w[k + 6 : k + 11])) > 0 AS repeats FROM e""",
)
def repeated_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bodies with a run of six words twice in a row; every third document's last six words are said again."""
    words = F.filter(F.split(F.lower(F.coalesce("text", F.lit(""))), "[^a-z0-9_]+"), lambda w: w != "")
    again = F.when((F.col("doc_id") % 3 == 0) & (F.size("w") > 5), F.slice("w", -6, 6)).otherwise(F.array().cast("array<string>"))
    docs = G.table(spark, sf_dir, "documents").select("doc_id", words.alias("w"))
    return docs.select("doc_id", analytics.residual_repetition(F.array_join(F.concat("w", again), " ")).alias("repeats"))


#: Letters put in place of Latin ones to make Greek titles, and what a letter alone is in Latin ones.
LATIN_KEYS, GREEK_LETTERS = "abcdefghijklmnopqrstuvwxyz", "αβγδεφγηιζκλμνοπθρστυωχξψμ"
ALONE = [("α", "a"), ("β", "v"), ("γ", "g"), ("δ", "d"), ("ε", "e"), ("φ", "f"), ("η", "i"), ("ι", "i"), ("ζ", "z"), ("κ", "k"), ("λ", "l"), ("μ", "m"), ("ν", "n"), ("ο", "o"), ("π", "p"), ("θ", "th"), ("ρ", "r"), ("σ", "s"), ("τ", "t"), ("υ", "y"), ("ω", "o"), ("χ", "ch"), ("ξ", "x"), ("ψ", "ps")]


def _greek_sql() -> str:
    """Digraphs first; those that may overlap twice."""
    x = "greek"
    for _ in range(2):
        x = f"regexp_replace({x}, '([αεη])υ([βγδζλμνραεηιουω])', '\\1v\\2', 'g')"
    x = f"replace(regexp_replace({x}, '([αεη])υ', '\\1f', 'g'), 'ου', 'ou')"
    x = f"replace(regexp_replace(regexp_replace({x}, '(^| )μπ', '\\1b', 'g'), 'μπ( |$)', 'b\\1', 'g'), 'μπ', 'mp')"
    for _ in range(2):
        x = f"regexp_replace({x}, 'γ([γξχ])', 'n\\1', 'g')"
    for letter, latin in ALONE:
        x = f"replace({x}, '{letter}', '{latin}')"
    return x


@query(
    "greek_titles",
    f"""WITH d AS (SELECT doc_id, array_to_string(list_filter(string_split_regex(lower(coalesce(text, '')), '[^a-z]+'), lambda x: x <> ''), ' ') AS title FROM documents),
g AS (SELECT doc_id, translate(title, '{LATIN_KEYS}', '{GREEK_LETTERS}') AS greek FROM d), r AS (SELECT doc_id, {_greek_sql()} AS romanized FROM g)
SELECT doc_id, romanized, replace(romanized, ' ', '-') AS slug FROM r""",
)
def greek_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words of documents in Greek letters, as Latin ones and as slugs."""
    words = F.filter(F.split(F.lower(F.coalesce("text", F.lit(""))), "[^a-z]+"), lambda w: w != "")
    greek = F.translate(F.array_join(words, " "), LATIN_KEYS, GREEK_LETTERS)
    docs = G.table(spark, sf_dir, "documents").select("doc_id", "text").repartition(spark.sparkContext.defaultParallelism, "doc_id")  # the test tables are single files
    titles = docs.select("doc_id", greek.alias("title"))
    romanized = titles.select("doc_id", romanize_greek(F.col("title")).alias("romanized"))  # once, for the slug too
    return romanized.select("doc_id", "romanized", kebab_case(F.col("romanized")).alias("slug"))


@query("stored_transcripts", "SELECT page_id, 'channel-' || page_id % 6 AS channel_folder, 'p' || page_id || '.md' AS filename, md5(html) AS contents_md5 FROM pages")
def stored_transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as transcripts, written to the sink and read back."""
    page = F.col("page_id")
    rows = G.table(spark, sf_dir, "pages").select("page_id", F.concat(F.lit("channel-"), (page % 6).cast("string")).alias("channel_folder"), F.concat(F.lit("p"), page.cast("string"), F.lit(".md")).alias("filename"), F.col("html").alias("contents"))
    path = fresh_path(spark, "transcripts")
    write_transcripts(rows, path)
    return spark.read.parquet(path).select("page_id", "channel_folder", "filename", F.md5("contents").alias("contents_md5"))
