"""Batches: what an expansion holds, what is there already, what is left to fetch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuemill.functions.targets import parse_target
from cuemill.functions.text import trim
from cuemill.operators.ordered import places, ranged

#: Lines of a batch's failures that are first joined to one text.
CHUNK = 1000


def parse_targets(inputs: DataFrame, column: str = "input", playlist: bool = False) -> DataFrame:
    """Adds target: struct<kind, url, video_id, video_number, path, error>."""
    return inputs.withColumn("target", parse_target(F.col(column), playlist))


def parse_expansion(expansions: DataFrame, stdout: str = "stdout", batch: str = "batch") -> DataFrame:
    """(batch, pos, url): the videos of listings, in order; lines that name no video are left out."""
    lines = expansions.select(F.col(batch).alias("batch"), F.posexplode(F.split(F.coalesce(F.col(stdout), F.lit("")), r"\r?\n")).alias("pos", "line"))
    read = lines.select("batch", "pos", parse_target(trim(F.col("line"))).alias("t"))
    return read.where("t.kind = 'video'").select("batch", "pos", F.col("t.url").alias("url"))


def distinct_in_order(expanded: DataFrame) -> DataFrame:
    """(pos, url): each url once, where it first stands. Null urls are left out."""
    return expanded.where("url is not null").groupBy("url").agg(F.min("pos").alias("pos")).select("pos", "url")


def plan_batch(expanded: DataFrame, existing: DataFrame, force: bool = False) -> tuple[DataFrame, DataFrame]:
    """(to fetch, to skip), both (pos, url) in order.

    A batch is small beside a corpus: the corpus is first cut down to the batch's urls, and only
    those decide. With force nothing is skipped.
    """
    wanted = distinct_in_order(expanded)
    if force:
        return wanted.orderBy("pos"), wanted.limit(0)
    there = existing.select("url").join(wanted.select("url"), "url", "left_semi").distinct()
    return wanted.join(there, "url", "left_anti").select("pos", "url").orderBy("pos"), wanted.join(there, "url", "left_semi").select("pos", "url").orderBy("pos")


def _counted(condition: Column) -> Column:
    return F.count_if(F.coalesce(condition, F.lit(False)))


def summarize_batch(results: DataFrame, batch: str = "batch") -> DataFrame:
    """(batch, fetched, skipped, failed, summary) of results (batch, pos, url, status, failure); status is fetched, skipped or failed."""
    one = results.groupBy(F.col(batch).alias("batch")).agg(*[_counted(F.col("status") == s).alias(s) for s in ("fetched", "skipped", "failed")])
    return one.withColumn("summary", F.format_string("%d fetched, %d skipped, %d failed.", "fetched", "skipped", "failed"))


def failure_lines(results: DataFrame, batch: str = "batch") -> DataFrame:
    """(batch, line, text): the roll-call of what failed, in order, under its heading (line 0); a batch of any size is spread over tasks."""
    said = F.concat(F.lit("  "), "url", F.when(F.coalesce("failure", F.lit("")) != "", F.concat(F.lit(" ("), "failure", F.lit(")"))).otherwise(""))
    failed = results.where("status = 'failed'").select(F.col(batch).alias("batch"), "pos", said.alias("text"))
    lines = places(ranged(failed, "batch", "pos", "text"), "batch", "line").select("batch", F.col("line").cast("long").alias("line"), "text")
    heads = failed.select("batch").distinct().select("batch", F.lit(0).cast("long").alias("line"), F.lit("Failed:").alias("text"))
    return heads.unionByName(lines)


def batch_report(results: DataFrame, batch: str = "batch", separator: str = "\n") -> DataFrame:
    """What summarize_batch gives, and failures: the roll-call of failure_lines as one text, empty where nothing failed.

    Lines are sorted over range partitions and joined in chunks of CHUNK, so that no group of a batch's
    rows is gathered; the chunks' texts make the batch's.
    """
    def joined(rows: DataFrame, key: list[str], order: str) -> DataFrame:
        found = rows.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct(order, "text"))).alias("t"))
        return found.select(*key, F.array_join(F.transform("t", lambda x: x["text"]), separator).alias("text"))

    lines = failure_lines(results, batch).withColumn("chunk", F.floor(F.col("line") / CHUNK))
    said = joined(joined(lines, ["batch", "chunk"], "line"), ["batch"], "chunk").select(F.col("batch").alias("_of"), F.col("text").alias("_said"))
    counts = summarize_batch(results, batch)
    return counts.join(said, F.col("batch").eqNullSafe(F.col("_of")), "left").select(*counts.columns, F.coalesce("_said", F.lit("")).alias("failures"))
