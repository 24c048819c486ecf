"""Vectors and rules of meetings, slugs, targets, outcomes, frontmatter, the store, sources and the stream."""

import os
import shutil
import uuid
from contextlib import contextmanager

import pytest
from pyspark.sql import functions as F

from cuemill.functions.slug import channel_folder, romanize, transcript_slug, usable_slug
from cuemill.functions.targets import parse_target
from cuemill.functions.text import format_duration, format_fetched, format_upload_date, quote_yaml, unquote
from cuemill.operators.ordered import PART, numbered, ranged
from cuemill.operators import analytics, corpus, meeting, outcomes, plan, select, store
from cuemill.sources.files import Found, dealt, read_files, write_files
from cuemill.sources.corpus import read_corpus, write_catalog, write_transcripts
from cuemill.sources.tables import IDENTITY, URL, save_bucketed, upsert_bucketed
from cuemill.sources.tracks import parse_listing, parse_metadata, read_meetings, read_tracks
from cuemill.streaming.incremental import METADATA, put, read_store, stream_transcripts
from cuemill.streaming.incremental import _partition as incremental_partition


@contextmanager
def many_parts(spark):
    """Small partitions stay apart, as large ones would."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def column(spark, values, f, kind="string"):
    rows = spark.createDataFrame([(k, v) for k, v in enumerate(values)], f"k int, v {kind}")
    return [r[0] for r in rows.select(f(F.col("v")), "k").orderBy("k").collect()]


def test_small_formats(spark):
    assert column(spark, ["20260910", " 2026 ", None, "20260910\n"], format_upload_date) == ["2026-09-10", "2026", "", "2026-09-10"]
    values = ['a "b" \\ c', "", None, '\\"', "x: y | z"]
    assert column(spark, values, lambda c: unquote(quote_yaml(c))) == [v or "" for v in values]
    assert column(spark, ['"a\\\\"b"', "plain", '"', '""'], unquote) == ['a\\"b', "plain", '"', ""]
    assert column(spark, [0, 499, 500, 59_500, 3_599_499, 3_599_500, 36_000_000], format_duration, "long") == ["0:00", "0:00", "0:01", "1:00", "59:59", "1:00:00", "10:00:00"]
    assert column(spark, [1_600_000_000], lambda c: format_fetched(F.timestamp_millis(c * 1000 + 999)), "long") == ["2020-09-13T12:26:40Z"]


@pytest.mark.parametrize(
    ("greek", "latin"),
    [("αύλος", "avlos"), ("άυλος", "aylos"), ("αυτός", "aftos"), ("εύκολο", "efkolo"), ("ευαγγέλιο", "evangelio"), ("ουρανός", "ouranos"), ("πρωτόυλη", "protoyli"), ("αϋπνία", "aypnia"), ("μπάλα", "bala"), ("λάμπα", "lampa"), ("κλαμπ", "klab"), ("έγχρωμο", "enchromo"), ("σφίγξ", "sfinx"), ("Ψυχή", "psychi"), ("ηύρα", "ivra"), ("x Ώρα 5", "x ora 5")],
)
def test_romanize(greek, latin):
    assert romanize(greek) == latin


def test_slugs(spark):
    long = "word " * 40
    titles = ["Don't Panic: \"It's\" 50% OFF!", "Søren Paweł Straße", "日本語", "日本語 ab", "--a/b--", "", None, long, "x" * 130, "Καλημέρα κόσμε", "Ångström ﬁne", "½"]
    got = column(spark, titles, usable_slug)
    assert got == ["dont-panic-its-50-off", "soren-pawel-strasse", None, None, "a-b", None, None, "-".join(["word"] * 24), "x" * 120, "kalimera-kosme", "angstrom-fine", "1-2"]
    rows = spark.createDataFrame([("@Some_One.x", "UC1"), (None, "UCab"), ("@", ""), ("日本", None), ("Νίκος", "U")], "h string, c string")
    assert [r[0] for r in rows.select(channel_folder(F.col("h"), F.col("c"))).collect()] == ["some-one-x", "ucab", "unknown-channel", "unknown-channel", "nikos"]
    assert column(spark, ["日本語"], lambda c: transcript_slug(c, F.lit("id"))) == ["id"]


V = "https://www.youtube.com/watch?v=abcdefghijk"


def test_targets(spark):
    accepted = {
        "youtube.com/watch?v=%61bcdefghijk": V, "youtube.com/playlist?list=PL%5F1%2Da": "https://www.youtube.com/playlist?list=PL_1-a",
        "abcdefghijk": V, " abcdefghijk\n": V, "youtu.be/abcdefghijk?si=1": V, "https://m.youtube.com/watch?list=PL1&v=abcdefghijk#t": V, "HTTPS://WWW.YOUTUBE.COM/shorts/abcdefghijk": V, "https://music.youtube.com/watch?v=abcdefghijk": V,
        "https://youtube.com/playlist?list=PL_1-a": "https://www.youtube.com/playlist?list=PL_1-a", "@some.one": "https://www.youtube.com/@some.one/videos", "youtube.com/@a/Shorts": "https://www.youtube.com/@a/Shorts",
        "youtube.com/c/Name/": "https://www.youtube.com/c/Name/videos", "https://x.com/a_b/status/12": "https://x.com/a_b/status/12", "http://www.twitter.com/i/status/12/video/2?s=2": "https://twitter.com/i/status/12/video/2",
        "mobile.x.com/i/web/status/9/photo/1/": "https://x.com/i/web/status/9/photo/1", "t.co/Ab1/": "https://t.co/Ab1",
    }
    got = column(spark, list(accepted), parse_target)
    assert [t.url for t in got] == list(accepted.values())
    again = column(spark, [t.url for t in got], parse_target)
    assert [t.url for t in again] == [t.url for t in got]
    assert [t.video_number for t in got[-4:]] == [1, 2, 1, 1]
    refused = ["", None, "https://example.com/watch?v=abcdefghijk", "https://youtube.com/watch?v=short", "youtube.com/playlist?list=", "youtube.com/", "x.com/a/status/x", "https://notyoutube.com/watch?v=abcdefghijk", "youtube.com/channel", "t.co/a/b", "short", "x.com/i/events/1"]
    assert all(t.kind is None and t.error for t in column(spark, refused, parse_target))
    assert column(spark, ["My meeting.VTT", "a/b.vtt"], parse_target)[0].kind == "file"
    assert column(spark, ["youtube.com/watch?v=abcdefghijk&list=PL1"], lambda c: parse_target(c, playlist=True))[0].kind == "playlist"


def test_outcomes(spark):
    refused = "WARNING: Unable to download video subtitles for 'en': HTTP Error 429: Too Many Requests"
    rows = [(0, True, None, "Twitter", "h", "1"), (0, False, None, "Twitter", "h", "1"), (0, False, refused, "Twitter", "h", "1"), (1, True, "", "Twitter", "h", "1"), (0, True, "", "Generic", "h", "1"), (0, True, "", "Twitter", "", "1"), (1, False, "ERROR: [generic] No video formats found", None, None, None),
            (1, False, "ERROR: [twitter] 1: No video could be found in this tweet", None, None, None), (1, False, "Media #2 is not a video", None, None, None), (1, False, "requires authentication", None, None, None), (1, False, "x\nERROR: Unsupported URL: y", None, None, None)]
    table = spark.createDataFrame(rows, "exit_code int, has_track boolean, stderr string, extractor_key string, uploader_id string, display_id string")
    video = [r.outcome.failure for r in outcomes.classify_fetch(table).collect()]
    assert video[:4] == [None, "no-subtitles", "rate-limited", "rate-limited"]
    post = [r.outcome.failure for r in outcomes.classify_post_fetch(table).collect()]
    assert post == [None, "no-subtitles", "rate-limited", "rate-limited", "not-an-x-post", "no-post-identity", "not-an-x-post", "no-video", "no-such-video", "login-required", "not-an-x-post"]
    said = column(spark, [*outcomes.MESSAGES, None], lambda c: outcomes.describe_failure(c, F.lit("URL"), F.lit("en")))
    assert all("URL" in s for s in said[:-1]) and said[-1] is None and len(set(said)) == 9


MEETING = """WEBVTT

u/2-0
00:00:01.000 --> 00:00:04.000
<v Ana Lopez>Hello</v>

u/1-1
00:00:02.000 --> 00:01:09.600
<v.loud Bo &amp; Co>again [laughs];</v>

u/1-0
00:00:02.000 --> 00:00:03.000
<v Bo &amp; Co>well</v> hm <v Ana Lopez>yes</v>

u/2-1
00:00:05.000 --> 00:00:06.000
<v Ana Lopez>there</v>

00:00:07.000 --> 00:00:08.000
no one

00:00:07.000 --> 00:00:08.000
no one either
"""


def test_meetings(spark):
    table = spark.createDataFrame([("m", MEETING), ("none", "WEBVTT\n"), ("unnamed", "WEBVTT\n\n00:00:01.000 --> 00:00:02.000\nhi\n")], "meeting string, raw string")
    got = {r.meeting: r for r in meeting.clean_meetings(table).collect()}
    turns = [(t.speaker, t.paragraphs) for t in got["m"].turns]
    assert turns == [("Ana Lopez", ["Hello there"]), ("Bo & Co", ["well"]), (None, ["hm"]), ("Ana Lopez", ["yes"]), ("Bo & Co", ["again ;"]), (None, ["no one"]), (None, ["no one either"])]
    assert (got["m"].layout, got["m"].duration) == ("meeting", "1:10")
    assert (got["none"].layout, got["none"].duration, got["none"].turns) == ("dialog", None, [])
    assert got["unnamed"].layout == "dialog"
    prose = {r.meeting: r for r in meeting.clean_meetings(table, "prose").collect()}["m"]
    assert [t.paragraphs for t in prose.turns] == [["Hello there well hm yes again ; no one no one either"]]


def test_track_choice(spark):
    rows = [("v", "auto", "en", "v.en.vtt"), ("v", "manual", "en-GB", "v.en-GB.vtt"), ("v", "manual", "en-US", "v.en-US.srt"), ("v", "manual", "en-US", "v.en-US.vtt"), ("v", "auto", "en-JkeT_87f4cc", "v.n.vtt"), ("w", "auto", "fr", "w.fr.vtt")]
    table = spark.createDataFrame(rows, "video_id string, track_kind string, track_key string, path string")
    assert {r.video_id: r.path for r in select.best_track(table).collect()} == {"v": "v.en-US.vtt", "w": "w.fr.vtt"}
    assert {r.video_id: r.passed_over for r in select.passed_over(table).collect()} == {"v": ["manual en-US", "manual en-GB", "auto en-JkeT_87f4cc"]}


def test_frontmatter_errors(spark):
    texts = ["no block", "---\ntitle: x", '﻿---\r\ntitle: "a \\"b\\""\r\ntitle: c: d\r\n\r\n---\r\nbody', "---\n?\nurl: u\n---\n", " --- \nurl:\n---", ""]
    got = column(spark, texts, corpus.read_frontmatter)
    assert [(f.is_transcript, f.error, f["values"]) for f in got] == [(False, None, None), (True, corpus.UNCLOSED, None), (True, None, {"title": "c: d"}), (True, corpus.UNREADABLE, {"url": "u"}), (True, None, {"url": ""}), (False, None, None)]
    empty = spark.createDataFrame([("a/x.md", "text")], "path string, text string")
    assert [tuple(r) for r in corpus.render_catalog(empty).collect()] == [(0, "# Transcripts"), (1, ""), (2, "0 transcripts, regenerated by cuemill catalog")]


def test_file_names_step_over_others(spark):
    incoming = spark.createDataFrame([("f", "url", u, "talk", c, k) for k, (u, c) in enumerate([("u1", "x"), ("u2", "x"), ("u3", "y"), ("u4", "x")])] + [("f", "url", "u5", "talk-x", "z", 9), ("f", "url", "u6", "other", "o", 3), ("g", "url", "u7", "talk", "q", 0)], "channel_folder string, identity_kind string, identity string, slug string, collision_id string, fetched int")
    existing = spark.createDataFrame([("f", "talk-y.md", None, None), ("f", "other.md", "url", "theirs"), ("g", "talk.md", "url", "u7")], "channel_folder string, filename string, identity_kind string, identity string")
    got = {r.identity: r.filename for r in store.resolve_filenames(incoming, existing).collect()}
    assert got == {"u1": "talk.md", "u2": "talk-x.md", "u3": "talk-y.md", "u4": "talk-x-2.md", "u5": "talk-x-z.md", "u6": "other-o.md", "u7": "talk.md"}


def _one_after_the_other(incoming, existing):
    """Names of incoming (folder, kind, identity, slug, collision_id, fetched), by plain loops over folders and first words."""
    head, out = lambda name: name.removesuffix(".md").split("-")[0], []
    for key in {(r[0], head(r[3])) for r in incoming}:
        held = {e[1]: e[2:] for e in existing if (e[0], head(e[1])) == key and e[2] is not None}
        for r in sorted((r for r in incoming if (r[0], head(r[3])) == key), key=lambda r: (r[5], r[1:4])):
            tries = [f"{r[3]}.md", f"{r[3]}-{r[4]}.md", *[f"{r[3]}-{r[4]}-{n}.md" for n in range(2, 500)]]
            name = next(n for n in tries if held.get(n, r[1:3]) == r[1:3])
            held = {n: owner for n, owner in held.items() if owner != r[1:3]} | {name: r[1:3]}
            out.append((*r, name))
    return sorted(out)


INCOMING = "channel_folder string, identity_kind string, identity string, slug string, collision_id string, fetched int"
EXISTING = "channel_folder string, filename string, identity_kind string, identity string"


def test_file_names_against_loops(spark):
    draw = __import__("random").Random(5)
    incoming, existing = [], {}
    for f in range(150):
        slugs = draw.choices(["a", "a-x", "a-x-2", "a-b", "b"], k=3)
        ids = [f"u{k}" for k in range(8)]
        for n in range(draw.randint(1, 7)):
            i = ids[n] if draw.random() < 0.8 else draw.choice(ids)
            incoming.append((f"f{f}", "url", i, draw.choice(slugs), draw.choice(["x", "x", "b", "y"]), draw.randint(0, 9)))
        for _ in range(draw.choice([0, 0, 1, 3])):
            name = draw.choice(slugs) + draw.choice(["", "-x", "-x-2", "-y"]) + ".md"
            existing[f"f{f}", name] = draw.choice([("url", draw.choice(ids)), ("url", "other"), (None, None)])
    rows = [(*k, *v) for k, v in existing.items()]
    unique = {(r[0], *r[2:3], r[3], r[5]): r for r in incoming}
    incoming = list(unique.values())
    got = store.resolve_filenames(spark.createDataFrame(incoming, INCOMING), spark.createDataFrame(rows, EXISTING)).collect()
    assert sorted(map(tuple, got)) == _one_after_the_other(incoming, rows)


def test_file_names_of_a_hot_word_are_not_gathered(spark, monkeypatch):
    def gathered(pdf):
        raise AssertionError("gathered")

    incoming = [("f", "url", f"u{k:03}", f"the-{k % 3}", "c" if k < 90 else f"c{k}", k) for k in range(300)]
    existing = [("f", "the-0.md", "url", "u150"), ("f", "the-1.md", "url", "other")]
    monkeypatch.setattr("pyspark.sql.group.GroupedData.applyInPandas", gathered)
    got = store.resolve_filenames(spark.createDataFrame(incoming, INCOMING), spark.createDataFrame(existing, EXISTING)).collect()
    assert sorted(map(tuple, got)) == _one_after_the_other(incoming, existing)


def test_batches(spark):
    expanded = spark.createDataFrame([(0, "a"), (1, "b"), (2, "a"), (3, "c"), (4, None)], "pos int, url string")
    existing = spark.createDataFrame([("b",), ("z",), (None,)], "url string")
    fetch, skip = plan.plan_batch(expanded, existing)
    assert [r.url for r in fetch.collect()] == ["a", "c"] and [r.url for r in skip.collect()] == ["b"]
    fetch, skip = plan.plan_batch(expanded, existing, force=True)
    assert [r.url for r in fetch.collect()] == ["a", "b", "c"] and skip.count() == 0


def test_metadata_and_listing(spark):
    got = column(spark, ['{"title": "old"}\n {"title": "t", "playlist_index": 2}\nend', "none", '{"a": 1}\n{broken', '{"title": null}', None], parse_metadata)
    assert [(m.title, m.playlist_index) if m else None for m in got] == [("t", 2), None, None, ("", None), None]
    lists = spark.createDataFrame([("p", '{"id": "a"}'), ("q", '{"id": "a", "playlist_index": 2}\n{"id": "b"}\n{"x": 1}\nz'), ("r", None)], "post_id string, stdout string")
    assert sorted((r.post_id, r.media_id, r.rank) for r in parse_listing(lists).collect()) == [("p", "a", 1), ("q", "a", 2)]


def test_alignment_and_lints(spark):
    ours = spark.createDataFrame([("v", 1000), ("v", 5000), ("w", 1)], "video_id string, at_ms long")
    theirs = spark.createDataFrame([("v", 2999), ("v", 3100)], "video_id string, at_ms long")
    got = {(r.video_id, r.at_ms): r.distance_ms for r in analytics.align_turns(ours, theirs, 2000).collect()}
    assert got == {("v", 1000): 1999, ("v", 5000): 1900, ("w", 1): None}
    assert column(spark, ["fine", "# h\n00:00:01.000 --> x <c> &amp;"], analytics.body_lint) == [[], ["heading", "timing", "timestamp", "markup", "entity"]]
    assert column(spark, ["a b c d e f a b c d e f", "a b c d e a b c d e"], analytics.residual_repetition) == [True, False]


TRACK = "WEBVTT\n\n00:00:01.000 --> 00:00:02.000\n{}\n"


def test_files_and_the_stream(spark, tmp_path):
    source, target = tmp_path / "in", tmp_path / "out"
    source.mkdir()
    (source / "v1.en.vtt").write_text(TRACK.format("one"))
    (source / "empty.en.vtt").write_text("")
    tracks = read_tracks(spark, str(source)).collect()
    assert [(t.video_id, t.track_key, t.ext) for t in tracks] == [("v1", "en", "vtt")]
    meetings = read_meetings(spark, str(source)).collect()
    assert {m.title: m.raw for m in meetings} == {"v1.en": (source / "v1.en.vtt").read_text(), "empty.en": ""}
    run = lambda: stream_transcripts(spark, str(source), str(target), str(tmp_path / "check")).awaitTermination()
    run()
    os.utime(source / "v1.en.vtt", (1, 1))
    (source / "v2.en.srt").write_text(TRACK.format("two"))
    (source / "v1.fr.vtt").write_text(TRACK.format("newer"))
    run()
    rows = {r.filename: r.contents.split("\n\n")[-1] for r in read_store(spark, str(target)).collect()}
    assert rows == {"v1.md": "newer\n", "v2.md": "two\n"}


def stamps(folder):
    return {str(p.relative_to(folder)): (p.stat().st_mtime_ns, p.stat().st_size) for p in folder.rglob("*.parquet")}


def test_a_batch_rewrites_only_what_it_meets(spark, tmp_path):
    store_path, partitions = tmp_path / "store", 16
    content = lambda word: bytearray(TRACK.format(word).encode())
    files = lambda *rows: spark.createDataFrame([(f"in/{n}.{key}.vtt", at, 1, content(word)) for n, key, at, word in rows], "path string, at long, length long, content binary").select("path", F.timestamp_seconds("at").alias("modificationTime"), "length", "content")
    metadata = spark.createDataFrame([(f"v{n}", "Same Title", "C", "@c", "", "", "") for n in range(40)], METADATA)
    put(files(*[(f"v{n}", "en", 100 + n, f"one{n}") for n in range(40)]), str(store_path), 0, metadata, partitions)
    first = stamps(store_path)
    rows = {r.identity[-2:].strip("="): r for r in read_store(spark, str(store_path)).collect()}
    assert len(rows) == 40 and rows["v0"].filename == "same-title.md" and rows["v7"].filename == "same-title-v7.md"
    again = files(("v7", "fr", 200, "worse"), ("v7", "en-US", 201, "better"), ("v7", "en-GB", 202, "other"))
    put(again, str(store_path), 1, metadata, partitions)
    second = stamps(store_path)
    kept = {p: s for p, s in second.items() if p in first}
    gone = [p.split("/")[0] for p in first if p not in second]
    assert len(set(gone)) == 1 and gone[0].startswith("partition=") and all(first[p] == s for p, s in kept.items())
    assert {p.split("/")[0] for p in second if p not in first} == {gone[0], "_marks"}
    now = {r.identity: r for r in read_store(spark, str(store_path)).collect()}
    assert len(now) == 40 and "better" in now["https://www.youtube.com/watch?v=v7"].contents and now["https://www.youtube.com/watch?v=v7"].filename == "same-title-v7.md"
    put(again, str(store_path), 1, metadata, partitions)
    assert stamps(store_path) == second, "a repeated batch changed something"
    # The rows are there, the mark is not: the batch is done again and comes out the same.
    shutil.rmtree(store_path / "_marks")
    before = sorted(map(str, read_store(spark, str(store_path)).collect()))
    put(again, str(store_path), 1, metadata, partitions)
    assert sorted(map(str, read_store(spark, str(store_path)).collect())) == before


def test_a_file_without_identity_makes_way(spark, tmp_path):
    store_path, partitions = tmp_path / "store", 16
    old = spark.createDataFrame([("unknown-channel", "v1.md", None, None, "mine", True), ("unknown-channel", "v2.md", None, None, "other", True)], "channel_folder string, filename string, identity_kind string, identity string, contents string, live boolean")
    old = old.withColumns({"fetched": F.lit(None).cast("timestamp"), "layout": F.lit("prose"), "partition": incremental_partition(partitions)})
    old.write.partitionBy("partition").parquet(str(store_path))
    files = spark.createDataFrame([("in/v1.en.vtt", 1, bytearray(TRACK.format("said").encode()))], "path string, length long, content binary").withColumn("modificationTime", F.timestamp_seconds(F.lit(9)))
    put(files, str(store_path), 0, partitions=partitions)
    found = {r.filename: (r.identity, r.contents[-5:]) for r in read_store(spark, str(store_path)).collect()}
    assert found == {"v1.md": ("https://www.youtube.com/watch?v=v1", "said\n"), "v2.md": (None, "other")}


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("a", "x.md", "text"), ("b", "y.md", "more")], "channel_folder string, filename string, contents string")
    write_transcripts(rows, str(tmp_path / "t"))
    assert spark.read.parquet(str(tmp_path / "t")).count() == 2
    lines = [f"line {k}" if k % 3 else "" for k in range(5000)]
    shuffled = spark.createDataFrame(list(enumerate(lines)), "line long, text string").repartition(7)
    with many_parts(spark):
        write_catalog(shuffled, str(tmp_path / "c"))
    parts = sorted((tmp_path / "c").glob("part-*"))
    assert len(parts) > 1 and "".join(p.read_text() for p in parts) == "".join(f"{x}\n" for x in lines)
    (tmp_path / "d" / "ch").mkdir(parents=True)
    (tmp_path / "d" / "top.MD").write_text("a")
    (tmp_path / "d" / "ch" / "with space.md").write_text("b")
    (tmp_path / "d" / "ch" / "deep").mkdir()
    (tmp_path / "d" / "ch" / "deep" / "no.md").write_text("c")
    assert sorted((r.path, r.text) for r in read_corpus(spark, str(tmp_path / "d")).collect()) == [("ch/with space.md", "b"), ("top.MD", "a")]


def test_small_files_make_few_tasks(spark, tmp_path):
    files = [("a b/ü%20+#?.MD", "odd"), ("_under.md", "u"), (".dot.md", ""), ("deep/er/x.md", "no"), *[(f"f{k % 3}/{k}.md", str(k)) for k in range(300)]]
    rows = spark.createDataFrame(files, "relative string, content string").repartition(5)
    write_files(rows, str(tmp_path / "in put"))
    read = read_files(spark, str(tmp_path / "in put"), "*.md", depth=1)
    assert {(r.relative, bytes(r.content).decode(), r.length) for r in read.collect()} == {(p, t, len(t)) for p, t in files if p != "deep/er/x.md"}
    assert read.rdd.getNumPartitions() == 1 and read_files(spark, str(tmp_path / "in put"), task_bytes=100 * (256 << 10)).rdd.getNumPartitions() in (4, 5)
    assert (tmp_path / "in put" / "a b" / "ü%20+#?.MD").read_text() == "odd" and not list((tmp_path / "in put").rglob("*-part"))
    write_files(spark.createDataFrame([("_under.md", "new")], "relative string, content string"), str(tmp_path / "in put"))
    assert (tmp_path / "in put" / "_under.md").read_text() == "new"
    assert read_files(spark, str(tmp_path / "none")).count() == 0
    assert [r.path for r in read_corpus(spark, str(tmp_path / "in put")).where("path like '%+%'").collect()] == ["a b/ü%20+#?.MD"]
    for bad in ("../x", "/x", "a/../../x"):
        with pytest.raises(Exception, match="no place below"):
            write_files(spark.createDataFrame([(bad, "x")], "relative string, content string"), str(tmp_path / "in put"))


def test_files_are_dealt_by_size():
    files = [Found(str(k), str(k), 0, size) for k, size in enumerate([10, 10, 900_000, 5, 2_000_000, 0, 0])]
    assert [[f.size for f in g.files] for g in dealt(files, 1_000_000)] == [[10, 10], [900_000], [5], [2_000_000], [0, 0]]


def test_numbers_without_one_task(spark):
    rows = spark.range(20_000).select((F.col("id") * 7919 % 20_000).alias("v"), "id").repartition(6)
    found = numbered(rows, F.desc("v"))
    assert found.where("line != 19999 - v").count() == 0 and found.count() == 20_000
    ties = numbered(spark.createDataFrame([(None, 1), ("a", 2), ("a", 2), (None, 1)], "s string, k int"), "s", "k")
    assert sorted((r.line, r.s) for r in ties.collect()) == [(0, None), (1, None), (2, "a"), (3, "a")]
    assert numbered(spark.createDataFrame([], "s string"), "s").count() == 0


def test_a_meeting_over_many_tasks(spark):
    """One meeting with most of the rows: its turns are islands stitched between parts, the same as one after the other."""
    import random

    draw = random.Random(3)
    speakers = [draw.choice(["Ann", "Bo", "", "Ann"]) for _ in range(4000)]
    credits = [("m", f"u/{k // 3}", k % 3, k, 0, who or None, [f"w{k}"]) for k, who in enumerate(speakers)] + [("n", "cue 0", 0, 0, 0, None, ["x"]), ("n", "cue 1", 0, 1, 0, "Ann", ["y"]), ("l", "cue 0", 0, 0, 0, "Ann", ["z"])]
    found = spark.createDataFrame(credits, "meeting string, utterance_key string, part long, position int, credit_no int, speaker string, words array<string>").repartition(5)
    turns = []
    for k, who in enumerate(speakers):
        joins = turns and (who and who == turns[-1][1] or not who and not turns[-1][1] and k // 3 == turns[-1][2])
        if joins:
            turns[-1][0].append(f"w{k}")
            turns[-1][2] = k // 3
        else:
            turns.append([[f"w{k}"], who, k // 3])
    with many_parts(spark):
        assert ranged(found.withColumn("first_position", F.col("position")), "meeting", "first_position").where("meeting = 'm'").select(PART).distinct().count() == 4
        got = {(r.meeting, r.turn_no): (r.speaker, r.words) for r in meeting.meeting_turns(found).collect()}
    assert {k[1]: v for k, v in got.items() if k[0] == "m"} == {n: (who or None, words) for n, (words, who, _) in enumerate(turns)}
    assert got["n", 0] == (None, ["x"]) and got["n", 1] == ("Ann", ["y"]) and got["l", 0] == ("Ann", ["z"])


def test_turn_rows_are_the_turns_of_meetings(spark):
    raw = "WEBVTT\n\n" + "\n\n".join(f"00:00:{k:02d}.000 --> 00:00:{k + 1:02d}.000\n<v {'Ann' if k % 3 else 'Bo'}>w{k}; and so on.</v>" for k in range(30))
    table = spark.createDataFrame([("a", raw), ("b", "WEBVTT\n\n00:00:00.000 --> 00:00:01.000\nnobody; said.\n"), ("c", "")], "meeting string, raw string")
    for layout in ("auto", "meeting", "dialog"):
        whole = {r.meeting: (r.layout, [tuple(t) for t in r.turns]) for r in meeting.clean_meetings(table, layout).collect()}
        rows = meeting.turn_rows(table, layout).orderBy("meeting", "turn_no").collect()
        for name in "ab":
            own = [r for r in rows if r.meeting == name]
            assert whole[name] == (own[0].layout, [(r.speaker, r.paragraphs) for r in own])
    assert whole["c"][1] == [] and not [r for r in rows if r.meeting == "c"]


def test_many_equal_slugs(spark):
    incoming = spark.range(100_000).select(F.lit("f").alias("channel_folder"), F.lit("url").alias("identity_kind"), F.col("id").cast("string").alias("identity"), F.lit("talk").alias("slug"), F.lit("c").alias("collision_id"), F.col("id").alias("fetched"))
    existing = spark.createDataFrame([("f", "talk-c-7.md", "url", "x"), ("f", "talk-c-50000.md", "url", "y")], "channel_folder string, filename string, identity_kind string, identity string")
    with many_parts(spark):
        found = store.resolve_filenames(incoming, existing)
        rows = dict(found.select("identity", "filename").collect())
    assert len(set(rows.values())) == 100_000
    want = ["talk.md", "talk-c.md", *[f"talk-c-{k}.md" for k in range(2, 100_002) if k not in (7, 50_000)]]
    assert [rows[str(k)] for k in range(100_000)] == want


def exchanges_below(plan, table):
    """Whether a scan of the table has an Exchange between itself and the join above it, in the text of a plan."""
    lines = plan.split("\n")
    found = []
    for k, line in enumerate(lines):
        if "FileScan" in line and table in line:
            depth, above = len(line) - len(line.lstrip(" :+-")), []
            for upper in reversed(lines[:k]):
                own = len(upper) - len(upper.lstrip(" :+-"))
                if own < depth:
                    depth = own
                    above.append(upper)
                    if "Join" in upper:
                        break
            found.append(any("Exchange" in x and "Broadcast" not in x for x in above))
    return found


def test_a_batch_reports_all_its_failures(spark):
    """Through the query's operator: counts, and every failed url in order, over chunks and for a null batch too."""
    n = plan.CHUNK * 2 + 5
    rows = [("a", k, f"u{k}", "failed" if k % 2 else "fetched", "rate-limited" if k % 3 else "") for k in range(2 * n)]
    rows += [(None, 1, "x", "failed", None), ("b", 1, "y", "skipped", None)]
    results = spark.createDataFrame(rows, "batch string, pos long, url string, status string, failure string")
    with many_parts(spark):
        found = {r.batch: r for r in plan.batch_report(results.repartition(7, "pos"), separator="|").collect()}
    assert found["a"].failures.split("|") == ["Failed:"] + [f"  u{k}" + (" (rate-limited)" if k % 3 else "") for k in range(2 * n) if k % 2]
    assert (found["a"].fetched, found["a"].failed, found["a"].summary) == (n, n, f"{n} fetched, 0 skipped, {n} failed.")
    assert (found[None].failed, found[None].failures) == (1, "Failed:|  x") and (found["b"].skipped, found["b"].failures) == (1, "")


def test_the_summary_of_batches_has_its_failures(spark):
    from cuemill.plans import corpus_queries

    first = corpus_queries.batch_summary(spark, "/root/testdata/sf0.001").where("failed > 0").first()
    assert first.failures.startswith("Failed:|  v") and first.failures.count("|") == first.failed


def test_bucketed_tables_stay_where_they_are(spark):
    rows = spark.range(3000).select(F.lit("c").alias("channel_folder"), F.concat(F.lit("f"), "id").alias("filename"), F.when(F.col("id") % 10 > 0, "url").alias("identity_kind"), F.when(F.col("id") % 10 > 0, F.col("id").cast("string")).alias("identity"), F.repeat(F.lit("text "), 50).alias("contents"))
    stored, urls = (f"test_{uuid.uuid4().hex}" for _ in range(2))
    save_bucketed(rows, stored, IDENTITY, 4)
    incoming = spark.createDataFrame([("c", "f10", "url", "7", "new"), ("d", "x", "url", "8", "new"), ("c", "f12", "url", "9999", "new")], "channel_folder string, filename string, identity_kind string, identity string, contents string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        done = upsert_bucketed(spark.table(stored), incoming, 4)
        got, want = (sorted(map(str, x.collect())) for x in (done, store.upsert(rows, incoming)))
        assert got == want and len(got) == 3000 - 4 + 3  # 7, 8, f10 and f12 go
        assert not any(exchanges_below(done._jdf.queryExecution().executedPlan().toString(), stored))
        save_bucketed(rows.select(F.concat(F.lit("u"), "filename").alias("url")), urls, URL, 4)
        expanded = spark.createDataFrame([(k, f"uf{k * 7}") for k in range(600)], "pos int, url string")
        fetch, skip = plan.plan_batch(expanded, spark.table(urls))
        assert skip.count() == 429 and fetch.count() == 171
        found = exchanges_below(fetch._jdf.queryExecution().executedPlan().toString(), urls)
        assert found and not any(found)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.sql(f"drop table if exists {stored}")
        spark.sql(f"drop table if exists {urls}")


def test_workers_get_the_package(tmp_path):
    """A session in another folder, whose workers do not have the package on their path."""
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = "\n".join([
        f"import sys; sys.path.insert(0, {root!r})",
        "from pyspark.sql import SparkSession",
        "import cuemill",
        "from cuemill.operators.clean import clean_tracks",
        "spark = SparkSession.builder.master('local[1]').config('spark.ui.enabled', 'false').getOrCreate()",
        "cuemill.ship(spark)",
        "rows = spark.createDataFrame([('00:00:01.000 --> 00:00:02.000\\nsaid here', 'en')], 'raw string, track_key string')",
        "print('TURNS', clean_tracks(rows).first().turns)",
    ])
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=200)
    assert "TURNS [['said here']]" in done.stdout, done.stderr[-2000:]


def test_words_without_marks_are_romanized_alike():
    """The short way of words without marks, the whole rules, and texts beyond two bytes; words that come again are remembered."""
    import random

    from cuemill.functions import slug

    draw = random.Random(3)
    words = ["".join(draw.choice("αβγεημοπξυχςγμυ") for _ in range(draw.randrange(1, 8))) for _ in range(3000)]
    whole = [slug._pattern().sub(slug._letter, w.lower().replace("ς", "σ")) for w in words]
    assert [romanize(w) for w in words] == whole
    assert romanize(" ".join(words).upper() + " 𐅀x") == " ".join(whole) + " 𐅀x"
    before = slug._remembered.cache_info().misses
    romanize(" ".join(words * 3))
    assert slug._remembered.cache_info().misses == before


def test_greek_titles_are_romanized_once(spark, tmp_path):
    from cuemill.plans.document_queries import greek_titles

    spark.createDataFrame([(1, "At the oyster"), (2, None)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    found = greek_titles(spark, str(tmp_path))
    calls = found._jdf.queryExecution().optimizedPlan().toString().count("_romanized(")
    assert calls == 1 and [tuple(r) for r in found.orderBy("doc_id").collect()] == [(1, "at tie opsster", "at-tie-opsster"), (2, "", "")]
