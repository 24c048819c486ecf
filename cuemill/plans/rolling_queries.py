"""Queries over captions that roll and change speakers, with the rules of overlaps and turns said in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cuemill.operators.clean import clean_tracks
from cuemill.plans import adapters as G
from cuemill.plans.track_queries import WORDS, query

#: Whatever a caption would take for markup is left out of the words.
PLAIN = r"regexp_replace(coalesce(text, ''), '[\[\]<>&-]', '', 'g')"


def _plain(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\[\]<>&-]", "")


def rolling_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(conv_id, track_key, raw): conversations as rolling captions with the marks of their turns.

    Each line stands under the line before it, and then alone. Some turns are followed by two short
    ones that open alike, and some by one that is nothing but applause.
    """
    turns = G.table(spark, sf_dir, "conversations").select("conv_id", "turn", G.words_of(_plain(F.col("text"))).alias("w"))
    n = F.ceil(F.size("w") / G.LINE_WORDS).cast("int")
    said = F.transform(F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>")), lambda i: F.concat(F.when(i == 0, "&gt;&gt; ").otherwise(""), F.array_join(F.slice("w", i * G.LINE_WORDS + 1, G.LINE_WORDS), " ")))
    short = F.when(F.col("turn") % 3 == 0, F.array(F.lit("&gt;&gt; Yeah."), F.lit("&gt;&gt; Yeah, sure."))).otherwise(F.array().cast("array<string>"))
    noise = F.when(F.col("turn") % 4 == 1, F.array(F.lit("&gt;&gt; [applause]"))).otherwise(F.array().cast("array<string>"))
    lines = turns.select("conv_id", F.struct("turn", F.concat(said, short, noise).alias("lines")).alias("t")).groupBy("conv_id").agg(F.flatten(F.transform(F.sort_array(F.collect_list("t")), lambda t: t["lines"])).alias("lines"))

    def cues(line: Column, k: Column) -> Column:
        start = k.cast("long") * G.LINE_MS
        above = F.when(k > 0, F.concat(F.get("lines", k - 1), F.lit("\n"))).otherwise("")
        setting = F.lit(" align:start position:0%\n")
        return F.concat(G.timing(start, start + 1990), setting, above, line, F.lit("\n\n"), G.timing(start + 1990, start + G.LINE_MS), setting, line)

    return lines.select("conv_id", F.lit("en").alias("track_key"), F.concat(F.lit("WEBVTT\n\n"), F.array_join(F.transform("lines", cues), "\n\n"), F.lit("\n")).alias("raw"))


#: A cue, and the stream so far: words w, their plain forms n, turn starts s and line starts l.
ROLLING = f"""t AS (SELECT conv_id, turn, {WORDS.format(text='x')} AS w FROM (SELECT conv_id, turn, {PLAIN} AS x FROM conversations)),
l AS (
  SELECT conv_id, turn, 0 AS part, i AS line, w[8 * i + 1 : 8 * i + 8] AS w, i = 0 AS opens FROM (SELECT *, unnest(range((len(w) + 7) // 8)) AS i FROM t)
  UNION ALL SELECT conv_id, turn, 1, unnest([0, 1]), unnest([['Yeah.'], ['Yeah,', 'sure.']]), true FROM t WHERE turn % 3 = 0
  UNION ALL SELECT conv_id, turn, 2, 0, CAST([] AS VARCHAR[]), true FROM t WHERE turn % 4 = 1),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, part, line) AS no FROM l),
p AS (SELECT conv_id, no, w, opens, lag(w) OVER q AS above, lag(opens) OVER q AS above_opens FROM o WINDOW q AS (PARTITION BY conv_id ORDER BY no)),
c AS (
  SELECT conv_id, 2 * no AS no, list_concat(coalesce(above, []), w) AS w, list_concat(CASE WHEN above_opens THEN [0] ELSE [] END, CASE WHEN opens THEN [len(coalesce(above, []))] ELSE [] END) AS s,
    CASE WHEN above IS NULL THEN [0] ELSE [0, len(above)] END AS l FROM p
  UNION ALL SELECT conv_id, 2 * no + 1, w, CASE WHEN opens THEN [0] ELSE [] END, [0] FROM p),
e AS (SELECT conv_id, no, {{'w': w, 'n': list_transform(w, lambda x: regexp_replace(lower(x), '[^\\p{{L}}\\p{{N}}_]', '', 'g')), 's': CAST(s AS BIGINT[]), 'l': CAST(l AS BIGINT[])}} AS cue FROM c),
g AS (SELECT conv_id, list_prepend({{'w': CAST([] AS VARCHAR[]), 'n': CAST([] AS VARCHAR[]), 's': CAST([] AS BIGINT[]), 'l': CAST([] AS BIGINT[])}}, list(cue ORDER BY no)) AS cues FROM e GROUP BY conv_id),
r AS (SELECT conv_id, list_reduce(cues, lambda a, x: list_transform([coalesce(list_filter(range(least(len(a.n), len(x.n)), 0, -1), lambda k:
    a.n[len(a.n) - k + 1 :] = x.n[1 : k] AND len(list_filter(x.n[1 : k], lambda y: y <> '')) > 0
    AND (len(list_filter(x.s, lambda q: q < k)) = 0 OR ((k = len(x.n) OR list_contains(x.l, k)) AND len(list_filter(x.s, lambda q: q < k AND NOT list_contains(a.s, len(a.n) - k + q))) = 0 AND (NOT list_contains(a.s, len(a.n)) OR list_contains(x.s, k)))))[1], 0)],
    lambda k: {{'w': list_concat(a.w, x.w[k + 1 :]), 'n': list_concat(a.n, x.n[k + 1 :]), 's': list_concat(a.s, list_transform(list_filter(x.s, lambda q: q >= k), lambda q: len(a.n) + q - k)), 'l': CAST([] AS BIGINT[])}})[1]) AS z FROM g),
h AS (SELECT conv_id, z.w AS w, list_concat([0], z.s, [len(z.w)]) AS cuts FROM r),
turns AS (SELECT conv_id, len(w) AS n_words, list_filter(list_transform(range(2, len(cuts) + 1), lambda k: w[cuts[k - 1] + 1 : cuts[k]]), lambda x: len(x) > 0) AS turns FROM h)"""


@query("rolling_turns", f"WITH {ROLLING} SELECT conv_id, len(turns) AS n_turns, n_words, md5(array_to_string(list_transform(turns, lambda x: array_to_string(x, ' ')), '|')) AS turns_md5 FROM turns")
def rolling_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rolling captions in plain words with turn starts: which repeats go, and which are new turns."""
    cleaned = clean_tracks(rolling_conversations(spark, sf_dir), "dialog")
    said = F.transform("turns", lambda t: F.array_join(t, " "))
    words = F.aggregate(said, F.lit(0).cast("long"), lambda a, t: a + F.size(F.split(t, " ")))
    return cleaned.select("conv_id", F.size("turns").cast("long").alias("n_turns"), words.alias("n_words"), F.md5(F.array_join(said, "|")).alias("turns_md5"))


@query(
    "continuations",
    f"""WITH t AS (SELECT conv_id, turn, {WORDS.format(text='x')} AS w FROM (SELECT conv_id, turn, {PLAIN} AS x FROM conversations)),
l AS (SELECT conv_id, turn, CASE turn % 3 WHEN 1 THEN list_prepend('...', w) WHEN 2 THEN list_prepend('…', w) ELSE w END AS w, turn % 3 = 0 AS opens FROM t),
i AS (SELECT *, sum(CASE WHEN opens THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS turn_no FROM l),
g AS (SELECT conv_id, turn_no, flatten(list(w ORDER BY turn)) AS w FROM i GROUP BY conv_id, turn_no)
SELECT conv_id, count(*) AS n_turns, md5(string_agg(array_to_string(w, ' '), '|' ORDER BY turn_no)) AS turns_md5 FROM g WHERE len(w) > 0 GROUP BY conv_id""",
)
def continuations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Manual tracks whose turns are interrupted: a line that goes on opens no turn."""
    turns = G.table(spark, sf_dir, "conversations").withColumn("order", F.col("turn"))
    opening = F.element_at(F.array(F.lit("- "), F.lit("- ... "), F.lit("- … ")), (F.col("turn") % 3 + 1).cast("int"))
    said = F.array_join(G.words_of(_plain(F.col("text"))), " ")
    # The turn's own words only: nothing is said where there are none and no dots.
    block = F.concat(G.timing(F.col("turn") * 5000, F.col("turn") * 5000 + 4000), F.lit("\n"), opening, said)
    cleaned = clean_tracks(G.by_conversation(turns, block).withColumn("track_key", F.lit("en")), "dialog")
    texts = F.transform("turns", lambda t: F.array_join(t, " "))
    return cleaned.where(F.size("turns") > 0).select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.md5(F.array_join(texts, "|")).alias("turns_md5"))
