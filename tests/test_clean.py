from pyspark.sql import functions as F

from cuemill.functions.cues import parse_cues
from cuemill.functions.text import classify_track, is_named_track, track_key
from cuemill.functions.artifacts import strip_cue
from cuemill.functions.turns import Stream, borders, normalized
from cuemill.operators.clean import clean_tracks


def one(spark, raw, column):
    return spark.createDataFrame([(raw,)], "raw string").select(column(F.col("raw"))).first()[0]


def track(*cues, setting=""):
    out = ["WEBVTT", "Kind: captions", ""]
    for k, lines in enumerate(cues):
        out += [f"00:00:{k:02d}.000 --> 00:00:{k + 1:02d}.500{setting}", *lines, ""]
    return "\n".join(out)


AUTO = " align:start position:0%"


def clean(spark, raw, key="en", layout="auto"):
    return clean_tracks(spark.createDataFrame([(raw, key)], "raw string, track_key string"), layout).first()


def test_blocks_and_cues(spark):
    raw = "WEBVTT\r\n\r\nNOTE 00 a note\r\n\r\n7\r\n00:00:01.000 --> 00:00:02,500\r\n1995\r\n \r\nNOTE said\r\n\r\n00:01:00.000 --> 01:00:00.001\r\n\r\na\r\n00:00:01.000 --> 00:00:02.000\r\nx\r\n00:00:03.000 --> 00:00:04.000\r\ny z\r\n"
    cues = one(spark, raw, lambda c: parse_cues(c, ids=True))
    assert [(c.start_ms, c.end_ms, c.lines, c.id) for c in cues] == [
        (1000, 2500, ["1995", "NOTE said"], "7"),
        (60000, 3600001, [], None),
        (1000, 2000, ["x"], "a"),
        (3000, 4000, ["y z"], "a"),
    ]
    assert one(spark, "", lambda c: parse_cues(c)) == []
    assert one(spark, "WEBVTT\n", lambda c: parse_cues(c)) == []


def test_kinds_and_names(spark):
    rows = spark.createDataFrame([("<c> a",), ("<c.red>x",), ("x align:start position:0%",), ("plain <cat>",)], "raw string")
    assert [r[0] for r in rows.select(classify_track(F.col("raw"))).collect()] == ["auto", "auto", "auto", "manual"]
    names = spark.createDataFrame([("v.en-JkeT_87f4cc.vtt",), ("v.en-US.vtt",), ("v.en-orig.srt",), ("v.abcd-JkeT_87f4cc.vtt",)], "f string")
    found = names.select(track_key(F.col("f")).alias("k")).select("k", is_named_track(F.col("k"))).collect()
    assert [tuple(r) for r in found] == [("en-JkeT_87f4cc", True), ("en-US", False), ("en-orig", False), ("abcd-JkeT_87f4cc", False)]
    assert normalized(["Ναι,", "«...»", "a_1½"]) == ["ναι", "", "a_1½"] and normalized([]) == []


def test_rolling_repeats_go(spark):
    raw = track(["one two<c> three</c>"], ["one two three", " "], ["one two three", "four five"], ["four five", "six"], setting=AUTO)
    assert clean(spark, raw).turns == [["one two three four five six"]]


def test_manual_keeps_repeats_and_annotations(spark):
    raw = track(["Transcriber: me"], ["very very", "good [Caplin?]"], ["very good (Laughter) (this one is far too long)"], ["subtitles by us, she said"], ["Amara"])
    assert clean(spark, raw).turns == [["very very good [Caplin?] very good (this one is far too long) subtitles by us, she said"]]


def test_turns_and_events(spark):
    raw = track(["&gt;&gt; hello [music] there"], ["&gt;&gt;&gt; [applause]"], ["&gt;&gt; me &amp;lt; you [is it?]"], setting=AUTO)
    row = clean(spark, raw, layout="dialog")
    assert row.turns == [["hello there"], ["me < you [is it?]"]]
    assert (row.layout, row.marks_turns, row.warnings) == ("dialog", True, [])
    assert clean(spark, raw).layout == "prose"


def test_continuations_and_named_tracks(spark):
    raw = track(["- one", "- ... two"], ["- three"])
    assert clean(spark, raw, layout="dialog").turns == [["one ... two"], ["three"]]
    named = track([">> one [sigh]"], [">>> two", "- three"])
    assert clean(spark, named, key="en-JkeT_87f4cc", layout="dialog").turns == [["one"], ["two - three"]]
    assert clean(spark, named, key="en", layout="dialog").warnings == []


def test_event_over_two_lines_keeps_its_marks(spark):
    raw = track(["&gt;&gt; a [loud", "&gt;&gt; music] b"], setting=AUTO)
    assert clean(spark, raw, layout="dialog").turns == [["a"], ["b"]]


def test_dialog_from_ten_turns_on_and_warning(spark):
    ten = track(*[[f"&gt;&gt; w{k}"] for k in range(10)], setting=AUTO)
    assert clean(spark, ten).layout == "dialog"
    nine = track(*[[f"&gt;&gt; w{k}"] for k in range(9)], setting=AUTO)
    assert clean(spark, nine).layout == "prose"
    assert len(clean(spark, track(["a b"]), layout="dialog").warnings) == 1
    empty = clean(spark, "WEBVTT\n", layout="dialog")
    assert empty.turns == [] and empty.warnings == []


def test_paragraphs_end_after_130_words(spark):
    words = [f"w{k}." if k % 10 == 9 else f"w{k}" for k in range(300)]
    words[129] = "w129"
    found = clean(spark, track([" ".join(words)])).turns
    assert [len(p.split()) for p in found[0]] == [140, 130, 30]


def rolled(*cues):
    """(overlaps, turn starts) of cues (text, turn starts, line starts)."""
    said = Stream()
    return [said.add(text.split(), list(turns), list(lines), True) for text, turns, lines in cues], said.turn_starts


def cue(text, starts=(), lines=(0,)):
    return text, starts, lines


def test_overlaps_that_hold_turn_starts():
    assert rolled(cue("yeah", [0]), cue("yeah sure", [0]))[0] == [0, 0]  # not a whole line: a new turn
    assert rolled(cue("yeah", [0]), cue("yeah sure", [0], [0, 1]))[0] == [0, 1]
    assert rolled(cue("a b"), cue("b c")) == ([0, 1], [])
    assert rolled(cue("a b", [0]), cue("a b c", [0, 2], [0, 2])) == ([0, 2], [0, 2])
    assert rolled(cue("a", [0, 1]), cue("a b", [0], [0, 1]))[0] == [0, 0]  # the stream's end has a start that the cue does not repeat
    assert rolled(cue("a a a"), cue("a a a"))[0] == [0, 3]
    assert rolled(cue(". ."), cue("."))[0] == [0, 0]  # no word at all
    assert rolled(cue("b a b a"), cue("b a b a b", [0, 4], [0, 2, 4]), cue("x"))[0] == [0, 0, 0]


def test_borders_against_slices():
    import random

    draw = random.Random(2)
    for _ in range(3000):
        head, tail = [[draw.choice("aab") for _ in range(draw.randrange(9))] for _ in range(2)]
        assert list(borders(head, tail)) == [k for k in range(min(len(head), len(tail)), 0, -1) if head[:k] == tail[-k:]]


def overlap_by_trying(words, starts, cue_words, turns, lines):
    """The rule as it is said, size by size."""
    norm = lambda ws: normalized(ws)
    for k in range(min(len(words), len(cue_words)), 0, -1):
        base = len(words) - k
        if norm(words[base:]) != norm(cue_words[:k]) or not any(norm(cue_words[:k])):
            continue
        taken = {t for t in turns if t < k}
        there = {s - base for s in starts if s >= base}
        if not taken or ((k == len(cue_words) or k in lines) and taken <= there and all(s < k or k in turns for s in there)):
            return k
    return 0


def test_streams_against_the_rule():
    import random

    draw = random.Random(5)
    for _ in range(2000):
        said, words, starts = Stream(), [], []
        for _ in range(draw.randrange(1, 7)):
            own = [draw.choice(["a", "A,", "b", "..."]) for _ in range(draw.randrange(6))]
            turns, lines = (sorted(draw.sample(range(len(own) + 1), draw.randrange(min(3, len(own) + 1)))) for _ in range(2))
            k = overlap_by_trying(words, starts, own, turns, lines)
            assert said.add(own, turns, lines, True) == k
            starts += [len(words) + t - k for t in turns if t >= k]
            words += own[k:]
        assert (said.words, said.turn_starts) == (words, starts)


def test_many_equal_words_end_soon():
    import time

    began = time.time()
    said = Stream()
    for _ in range(3):
        said.add(["so"] * 100_000, [0, 50_000], [0, 50_000], True)
    assert time.time() - began < 10 and len(said.words) >= 100_000


def test_places_of_turns_and_lines():
    assert strip_cue("one two\nthree", "auto") == (["one", "two", "three"], [], [0, 2])
    assert strip_cue(">> one [x]\n>>> two >> three", "auto") == (["one", "two", ">>", "three"], [0, 1], [0, 1])
    assert strip_cue(">>\n>> a", "auto") == (["a"], [0, 0], [0, 0])
    assert strip_cue("- a\n- ... b\n-\n- … c\n-d", "manual") == (["a", "...", "b", "-", "…", "c", "-d"], [0], [0, 1, 3, 4, 6])
    assert strip_cue("a [loud\n>> music] b\nc [d", "auto") == (["a", "b", "c", "[d"], [1], [0, 1, 2])
    assert strip_cue("x (one two three four five) (y. z) ( )", "manual") == (["x", "(one", "two", "three", "four", "five)", "(y.", "z)"], [], [0])
    assert strip_cue("[a [b] c] [d", "auto") == (["[a", "c]", "[d"], [], [0])


def test_rolling_turns_as_shown(spark):
    """Exchanges in rolling cues, with their turn starts: repeated lines count once, recurring words stay."""
    shown = [
        ([["So what do you think?"], ["Yeah."], ["Yeah, sure."], ["Great."]], ["So what do you think?", "Yeah.", "Yeah, sure.", "Great."]),
        ([["So what do you think?"], ["So what do you think?", "Yeah."], ["Yeah."], ["Yeah.", "Yeah, sure."], ["Yeah, sure."], ["Yeah, sure.", "Great."]], ["So what do you think?", "Yeah.", "Yeah, sure.", "Great."]),
        ([["Thank you."], ["[applause]"], ["Thank you."], ["Bye."]], ["Thank you.", "Thank you.", "Bye."]),
    ]
    for cues, turns in shown:
        raw = track(*[[f"&gt;&gt; {line}" for line in lines] for lines in cues], setting=AUTO)
        assert clean(spark, raw, layout="dialog").turns == [[t] for t in turns]
    assert clean(spark, track(["I said yes."], ["&gt;&gt; Yes."], setting=AUTO), layout="dialog").turns == [["I said yes."], ["Yes."]]
    rolling = [x for k in range(10) for x in ([f"&gt;&gt; Turn {k} opens.", f"Turn {k} goes on."], [f"Turn {k} goes on.", f"&gt;&gt; Turn {k + 1} opens."])]
    assert clean(spark, track(*rolling[:17], setting=AUTO)).layout == "prose"
    ten = clean(spark, track(*rolling[:19], setting=AUTO))
    assert (ten.layout, len(ten.turns)) == ("dialog", 10)


def test_meeting_documents_without_a_slug_have_no_name(spark):
    from pyspark.sql import functions as F

    from cuemill.operators.meeting import meeting_documents

    raw = "WEBVTT\n\na/1-0\n00:00:00.000 --> 00:00:02.500\n<v Ann>Hello there.</v>\n\na/2-0\n00:00:03.000 --> 00:00:04.500\n<v Bo>Yes.</v>\n"
    rows = [(1, "Weekly Sync", raw), (2, "会議", raw), (3, "Empty", "WEBVTT\n")]
    table = spark.createDataFrame(rows, "meeting int, title string, raw string").withColumn("modified_at", F.lit("2021-03-04 12:00:00").cast("timestamp"))
    found = {r.meeting: r for r in meeting_documents(table, F.timestamp_seconds(F.lit(1_600_000_000))).collect()}
    assert found[1].filename == "weekly-sync.md" and found[2].filename is None
    assert found[1].contents.endswith('duration: "0:05"\nupload_date: 2021-03-04\nfetched: 2020-09-13T12:26:40Z\nsubtitles: auto\nlayout: meeting\n---\n\n— **Ann:** Hello there.\n\n— **Bo:** Yes.\n')
    assert found[3].contents.endswith("layout: dialog\n---\n\n\n")


def test_words_are_conserved_through_cleaning(spark, monkeypatch, tmp_path):
    """word_conservation compares with what cleaning gives: a cleaning that drops a word loses one, and whatever words are made of stays."""
    from cuemill.plans import track_queries

    texts = ["a [music] <b>b &amp; c</b> --> >> x- (d) e", "so so so so so so so so so so", "été %41 a+b w1_x x2_y\ue000 \u00a0", "", None]
    rows = [(3 * k + 1, t) for k, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    found = lambda: {r.doc_id: (r.lost, r.gained) for r in track_queries.word_conservation(spark, str(tmp_path)).collect()}
    assert found() == {k: (0, 0) for k, _ in rows}
    whole = track_queries.word_streams
    short = lambda tracks: whole(tracks).withColumn("_stream", F.struct(F.slice("_stream.words", 2, 1_000_000).alias("words"), F.col("_stream.turn_starts").alias("turn_starts")))
    monkeypatch.setattr(track_queries, "word_streams", short)
    assert found() == {k: (1 if t else 0, 0) for k, t in rows}


def documents(spark, folder, texts):
    rows = [(k, t, "en", f"src{k}", len(t or "")) for k, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    return str(folder)


def test_documents_without_words_are_auto_tracks(spark, tmp_path):
    from cuemill.plans import track_queries

    found = track_queries.clean_tracks_query(spark, documents(spark, tmp_path, [None, "", " \n ", "a"])).orderBy("doc_id").collect()
    assert [tuple(r)[1:] for r in found] == [("auto", "prose", 0, 0, 0)] * 3 + [("auto", "prose", 1, 1, 1)]


def test_documents_without_words_are_rendered_as_auto(spark, tmp_path):
    from hashlib import md5

    from cuemill.plans import track_queries

    block = '---\ntitle: "Document {0} \\\\ \\"x\\""\nurl: https://www.youtube.com/watch?v={0}\nchannel: "src{0}"\nduration: "1:00"\nupload_date: 2020-05-17\nfetched: 2020-09-13T12:26:40Z\nsubtitles: auto\nlayout: prose\n---\n\n{1}\n'
    found = {r.doc_id: r.contents_md5 for r in track_queries.render_transcripts(spark, documents(spark, tmp_path, [None, "", "a  b"])).collect()}
    assert found == {k: md5(block.format(k, body).encode()).hexdigest() for k, body in enumerate(["", "", "w0_a w1_b"])}


def test_tracks_are_read_whole_as_cue_by_cue(spark):
    """heard, which reads the text, against parse_cues and cue_text, which read cues; the tracks break all rules there are."""
    import random

    from cuemill.functions.speech import cue_text, heard, spoken

    draw = random.Random(7)
    times = ["00:00:01.000 --> 00:00:02.000", "00:00:01,000-->00:00:02,000 align:start position:0%", " x 00:00:01.000\u00a0 --> 00:00:02.000", "100:00:01.000 --> 100:00:02.000", "١٢:00:00.000 --> 00:00:02.000"]
    words = ["a", "b", "A,", "...", "- c", "&gt;&gt; d", ">> e", "<c> g</c>", "<c", "h>", "&amp;lt;j&gt;", "[music]", "[one", "two]", "(x y)", "ΣΑΣ", "\u00a0", "\t", "\x0b", "\x1c", "\ufeff", "k\ue000l", "\ue000", "", "  ", " ", "Transcriber: n", "\r", "İ", "½", "-->"]
    ends = ["\n", "\n", "\n\n", "\r\n", "\r\n\r\n", "\n\r\n", "\n \n", "\n\n\n", "\r\r\n"]
    rows = []
    for k in range(1500):
        out, above = [draw.choice(["WEBVTT\n\n", "", "\n"])], ""
        for _ in range(draw.randrange(9)):
            line = " ".join(draw.choice(words) for _ in range(draw.randrange(5)))
            out += [draw.choice(["", "", "", "id\n"]), draw.choice(times[:2] * 5 + times), draw.choice(ends[:2]), draw.choice(["", above + "\n"]) + line, draw.choice(["\n\n", *ends])]
            above = line
        rows.append((k, "".join(out) if k % 100 else None, draw.choice(["auto", "manual"]), draw.random() < 0.7))
    tracks = spark.createDataFrame(rows, "k int, raw string, notation string, dedup boolean")
    cut = tracks.select("*", F.explode(F.array(cue_text(F.transform(parse_cues(F.col("raw"), times=False), lambda c: c["lines"])))).alias("text"))
    found = lambda frame, said: {r.k: (r.s.words, r.s.turn_starts) for r in frame.select("k", said.alias("s")).collect()}
    whole = found(tracks, heard(F.col("raw"), F.col("notation"), F.col("dedup")))
    assert len(whole) == 1500 and whole == found(cut, spoken(F.col("text"), F.col("notation"), F.col("dedup")))


def test_lines_that_come_again_are_read_once(monkeypatch):
    from cuemill.functions import speech

    read = []
    whole = speech.lowered
    monkeypatch.setattr(speech, "lowered", lambda text, kept: read.append(text) or whole(text, kept))
    lines = [f"w{k} is, said" for k in range(50)]
    rolled = [cue for k, line in enumerate(lines) for cue in ("\n".join(lines[max(k - 1, 0) : k + 1]), line)]
    assert speech.stream(speech.CUE.join(rolled), "auto", True) == (" ".join(lines).split(" "), [])
    assert read == ["\n".join(lines)]


def test_repeated_runs_are_found_in_tracks_read_whole(spark, tmp_path):
    from cuemill.plans import track_queries

    run = "One two three four five six"
    found = track_queries.residual_repetition(spark, documents(spark, tmp_path, [f"{run} {run.lower()} x", f"{run} x {run}", "so " * 40, None, ""]))
    assert "_heard(" in found._jdf.queryExecution().optimizedPlan().toString()
    assert [r.repeats for r in found.orderBy("doc_id").collect()] == [True, False, True, False, False]


def test_warnings_need_no_paragraphs(spark, tmp_path):
    from cuemill.functions.text import SENTENCE_END
    from cuemill.plans import document_queries, track_queries

    folder = documents(spark, tmp_path, ["a b", None])
    plan = lambda f: f(spark, folder)._jdf.queryExecution().optimizedPlan().toString()
    assert SENTENCE_END in plan(track_queries.clean_tracks_query) and SENTENCE_END not in plan(document_queries.asked_dialogs)
    warnings = [r.warning for r in document_queries.asked_dialogs(spark, folder).orderBy("doc_id").collect()]
    assert warnings == ["A dialog was asked for, but no change of speaker is marked in d0", ""]


def test_words_are_counted_within_their_rows(spark, tmp_path):
    from cuemill.operators import analytics
    from cuemill.plans import track_queries

    found = track_queries.word_conservation(spark, documents(spark, tmp_path, ["a b"]))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Aggregate" not in plan
    sides = [spark.createDataFrame(rows, "track int, words array<string>") for rows in ([(1, list("aab")), (2, ["x"]), (3, None), (4, ["y"])], [(1, list("bca")), (2, ["x"]), (3, ["z"])])]
    assert {tuple(r) for r in analytics.word_conservation(*sides).collect()} == {(1, 1, 1), (2, 0, 0), (3, 0, 1), (4, 1, 0)}


def test_rendered_texts_are_not_sorted(spark, tmp_path):
    from cuemill.plans import track_queries

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    found = track_queries.render_transcripts(spark, documents(spark, tmp_path, ["a b", None]))
    plan = found._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "ShuffledHashJoin" in plan and "Sort" not in plan.replace("SortAggregate", "")
    assert {(r.doc_id, r.filename, r.channel_folder) for r in found.collect()} == {(0, "document-0.md", "src0"), (1, "document-1.md", "src1")}
