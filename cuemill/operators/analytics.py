"""What tracks and transcripts are like: profiles, markers, turns, alignment and checks."""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cuemill.functions.cues import parse_cues
from cuemill.functions.text import clean_line, is_named_track
from cuemill.operators.ordered import neighbours, ranged


def cues_of(tracks: DataFrame, track: str = "track", raw: str = "raw") -> DataFrame:
    """(track, pos, start_ms, end_ms, lines): a row per cue, in the track's order."""
    return tracks.select(F.col(track).alias("track"), F.posexplode(parse_cues(F.col(raw))).alias("pos", "c")).select("track", "pos", "c.start_ms", "c.end_ms", "c.lines")


def track_profile(tracks: DataFrame, track: str = "track", raw: str = "raw") -> DataFrame:
    """(track, bytes, cues, word_tags, first_start_ms, last_start_ms, last_end_ms), worked out within the row."""
    found = tracks.select(F.col(track).alias("track"), F.octet_length(raw).alias("bytes"), F.regexp_count(raw, F.lit(r"<c[\s.>]")).alias("word_tags"), parse_cues(F.col(raw)).alias("c"))
    last = F.when(F.size("c") > 0, F.element_at("c", -1))
    return found.select("track", "bytes", F.size("c").alias("cues"), "word_tags", F.get("c", 0)["start_ms"].alias("first_start_ms"), last["start_ms"].alias("last_start_ms"), last["end_ms"].alias("last_end_ms"))


def cue_gaps(cues: DataFrame) -> DataFrame:
    """Adds gap_ms: from the end of the cue before, null for the first."""
    return cues.withColumn("gap_ms", F.col("start_ms") - F.lag("end_ms").over(Window.partitionBy("track").orderBy("pos")))


def marker_counts(cues: DataFrame) -> DataFrame:
    """(track, raw_markers, distinct_markers, noise_markers, per_hour) of lines that open with a speaker marker.

    A line is distinct if the cue before does not hold it, and noise if all it says is in brackets.
    The rate is that of distinct lines that are no noise, over the time to the last cue's end.
    """
    lines = F.transform("lines", clean_line)
    before = F.lag("clean").over(Window.partitionBy("track").orderBy("pos"))
    marked = cues.withColumn("clean", lines).withColumn("before", F.coalesce(before, F.array().cast("array<string>")))
    each = marked.select("track", "end_ms", "before", F.explode_outer("clean").alias("line"))
    is_marker = F.coalesce(F.col("line").rlike("^>>"), F.lit(False))
    new = is_marker & ~F.array_contains("before", F.coalesce("line", F.lit("")))
    noise = F.coalesce(F.col("line").rlike(r"^>>>?\s*\[[^\[\]]*\]\z"), F.lit(False))
    one = each.groupBy("track").agg(F.count_if(is_marker).alias("raw_markers"), F.count_if(new).alias("distinct_markers"), F.count_if(new & noise).alias("noise_markers"), F.max("end_ms").alias("end_ms"))
    rate = (F.col("distinct_markers") - F.col("noise_markers")) * 3_600_000 / F.nullif("end_ms", F.lit(0))
    return one.select("track", "raw_markers", "distinct_markers", "noise_markers", rate.alias("per_hour"))


def turn_stats(turns: DataFrame) -> DataFrame:
    """(track, turns, median_words, max_words, short_share) of turns (track, n_words); short is up to three words."""
    return turns.groupBy("track").agg(
        F.count(F.lit(1)).alias("turns"), F.percentile("n_words", 0.5).alias("median_words"), F.max("n_words").alias("max_words"), F.avg((F.col("n_words") <= 3).cast("double")).alias("short_share")
    )


def turn_sketches(turns: DataFrame, *by: str) -> DataFrame:
    """(by..., turns, sizes, max_words, short) of turns (by..., n_words): what `turn_stats` needs, in a few kilobytes that can be kept and merged.

    sizes is a KLL sketch of the words per turn (k = 200: a median's rank is off by about 1.7 %, and
    right for up to 200 turns).
    """
    short = F.count_if(F.col("n_words") <= 3)
    return turns.groupBy(*by).agg(F.count(F.lit(1)).alias("turns"), F.kll_sketch_agg_bigint(F.col("n_words").cast("long")).alias("sizes"), F.max("n_words").alias("max_words"), short.alias("short"))


def merged_turn_stats(sketches: DataFrame, *by: str) -> DataFrame:
    """(by..., turns, median_words, max_words, short_share) of the sketches of any number of batches; the median is a size that occurs."""
    one = sketches.groupBy(*by).agg(F.sum("turns").alias("turns"), F.kll_merge_agg_bigint("sizes").alias("sizes"), F.max("max_words").alias("max_words"), F.sum("short").alias("short"))
    return one.select(*by, "turns", F.kll_sketch_get_quantile_bigint("sizes", F.lit(0.5)).alias("median_words"), "max_words", (F.col("short") / F.col("turns")).alias("short_share"))


def key_sketches(keys: DataFrame, *by: str, key: str = "track_key") -> DataFrame:
    """(by..., keys, named): HyperLogLog sketches of distinct track keys and of those that name a track (2^12 registers: off by about 1.6 %)."""
    named = F.when(is_named_track(F.col(key)), F.col(key))
    sketch = lambda c: F.hll_sketch_agg(c, 12)
    return keys.groupBy(*by).agg(sketch(F.col(key)).alias("keys"), sketch(named).alias("named"))


def merged_key_census(sketches: DataFrame, *by: str) -> DataFrame:
    """(by..., keys, named): about how many distinct track keys the sketches of any number of batches have seen."""
    return sketches.groupBy(*by).agg(*[F.hll_sketch_estimate(F.hll_union_agg(c)).alias(c) for c in ("keys", "named")])


def _swept(sides: DataFrame) -> DataFrame:
    """Rows (video_id, at_ms, side, ...) of both sides with distance_ms, to the nearest of the other: one sweep in order of time, no pairs."""
    timed = ranged(sides, "video_id", "at_ms")
    met = neighbours(timed, "video_id", {f"_{k}": F.when(F.col("side") == k, F.col("at_ms")) for k in (0, 1)})
    gap = lambda k: F.least(F.col("at_ms") - F.col(f"_{k}_before"), F.col(f"_{k}_after") - F.col("at_ms"))
    distance = F.when(F.col("video_id").isNotNull(), F.when(F.col("side") == 0, gap(1)).otherwise(gap(0)))
    return met.withColumn("distance_ms", distance)


def align_turns(ours: DataFrame, theirs: DataFrame, window_ms: int) -> DataFrame:
    """Adds distance_ms: from each of our turn starts (video_id, at_ms) to the nearest of theirs, null if none is within the window.

    Starts without a video or a time are near nothing.
    """
    left = ours.select("video_id", "at_ms", F.lit(0).alias("side"), F.struct(*ours.columns).alias("row"))
    right = theirs.where("at_ms is not null").select("video_id", "at_ms", F.lit(1).alias("side"), F.lit(None).cast(left.schema["row"].dataType).alias("row"))
    swept = _swept(left.unionByName(right)).where("side = 0")
    return swept.select("row.*", F.when(F.col("distance_ms") <= window_ms, F.col("distance_ms")).alias("distance_ms"))


def alignment(auto: DataFrame, manual: DataFrame, windows: tuple[int, ...] = (2000, 4000, 8000)) -> DataFrame:
    """(window_ms, precision, recall) of automatic turn starts against manual ones; null where there are no starts."""
    side = lambda starts, k: starts.select("video_id", "at_ms", F.lit(k).alias("side")).distinct()
    swept = _swept(side(auto, 0).unionByName(side(manual, 1)))
    share = lambda k, w: F.avg(F.when(F.col("side") == k, F.coalesce(F.col("distance_ms") <= w, F.lit(False)).cast("double")))
    one = swept.agg(*[share(k, w).alias(f"s{k}_{w}") for w in windows for k in (0, 1)])
    rows = F.array(*[F.struct(F.lit(w).alias("window_ms"), F.col(f"s0_{w}").alias("precision"), F.col(f"s1_{w}").alias("recall")) for w in windows])
    return one.select(F.inline(rows))


def key_census(keys: DataFrame, key: str = "track_key") -> DataFrame:
    """One row: distinct track keys, and how many of them name a track."""
    distinct = keys.select(F.col(key).alias("k")).where("k is not null").distinct()
    return distinct.agg(F.count(F.lit(1)).alias("keys"), F.count_if(is_named_track(F.col("k"))).alias("named"))


@F.arrow_udf(T.StructType([T.StructField("lost", T.LongType()), T.StructField("gained", T.LongType())]))
def _unpaired(before: pa.Array, after: pa.Array) -> pa.Array:
    lost, gained = [], []
    for k in range(len(before)):
        b, a = Counter(before[k].as_py() or ()), Counter(after[k].as_py() or ())
        lost.append(0 if b == a else (b - a).total())
        gained.append(0 if b == a else (a - b).total())
    return pa.StructArray.from_arrays([pa.array(lost, pa.int64()), pa.array(gained, pa.int64())], ["lost", "gained"])


def unpaired_words(before: Column, after: Column) -> Column:
    """struct<lost, gained> of two arrays of words in any order: those that do not pair up, as counts. Nothing is shuffled."""
    return _unpaired(before, after)


def word_conservation(before: DataFrame, after: DataFrame) -> DataFrame:
    """(track, lost, gained): words of before and after (track, words array<string>) that do not pair up, as counts.

    Both have one row for a track. Where both are columns of one row already, `unpaired_words` needs no join.
    """
    both = before.select("track", F.col("words").alias("b")).join(after.select("track", F.col("words").alias("a")), "track", "left")
    return both.select("track", unpaired_words(F.col("b"), F.col("a")).alias("x")).select("track", "x.lost", "x.gained")


def residual_repetition(body: Column) -> Column:
    """Whether a run of six words stands twice in a row."""
    return body.rlike(r"(?i)\b(\w+(?: \w+){5}) \1\b")


def body_lint(body: Column) -> Column:
    """array<string>: what a body should not have, and has."""
    checks = {"heading": r"(?m)^#", "timing": "-->", "timestamp": r"\d{2}:\d{2}:\d{2}[.,]\d{3}", "markup": "<[^>]*>", "entity": "&(?:amp|lt|gt|quot|#39);"}
    return F.filter(F.array(*[F.when(body.rlike(pattern), name) for name, pattern in checks.items()]), lambda x: x.isNotNull())


def label_census(lines: DataFrame) -> DataFrame:
    """(track, labels, recurring, named) of lines (track, line): `NAME:` labels that open lines.

    Speakers count as named from two labels on that occur more than once.
    """
    label = F.regexp_extract("line", r"^([\p{Lu}][\p{L} .'-]{0,40}):(?:\s|\z)", 1)
    counted = lines.select("track", label.alias("label")).groupBy("track", "label").count()
    real = F.col("label") != ""
    return counted.groupBy("track").agg(F.count_if(real).alias("labels"), F.count_if(real & (F.col("count") > 1)).alias("recurring")).withColumn("named", F.col("recurring") >= 2)


def identical_tracks(tracks: DataFrame, raw: str = "raw") -> DataFrame:
    """(video_id, digest, track_keys): groups of a video's tracks that are byte for byte alike."""
    found = tracks.select("video_id", "track_key", F.sha2(F.col(raw).cast("binary"), 256).alias("digest")).groupBy("video_id", "digest")
    return found.agg(F.sort_array(F.collect_set("track_key")).alias("track_keys"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")

