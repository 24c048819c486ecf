"""Transcript files, and the sinks of transcripts and of the catalog."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuemill.sources.files import read_files


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """(path, text) of Markdown files in a folder and in the folders right below it; paths are relative."""
    return read_files(spark, path, "*.md", depth=1).select(F.col("relative").alias("path"), F.decode("content", "UTF-8").alias("text"))


def write_transcripts(transcripts: DataFrame, path: str, rows_a_file: int = 100_000, mode: str = "overwrite") -> None:
    """One row per document, in a folder for each channel. A folder with most of the rows is spread over tasks."""
    spread = transcripts.repartition("channel_folder", F.pmod(F.xxhash64("filename"), F.lit(32)))
    spread.write.mode(mode).option("maxRecordsPerFile", rows_a_file).partitionBy("channel_folder").parquet(path)


def write_catalog(lines: DataFrame, path: str) -> None:
    """The rendered catalog (line, text), in place of the last one, as text files that make the document in the order of their names."""
    lines.orderBy("line").select("text").write.mode("overwrite").text(path)
