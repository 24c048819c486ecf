"""What several operators need: the folder that all machines share, and tables kept there."""

from __future__ import annotations

import gc
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuemill.sources.shared import fresh_path, keep, shared_folder  # noqa: F401  the operators' own


def drop_finished_shuffles(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of jobs that are done, before a step that writes large ones.

    It deletes them when the driver collects its garbage, which a driver with little to do may put off for long.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


_holders: list[tuple[str, Callable[[], None]]] = []


def take_over(name: str, forget: Callable[[], None] | None = None) -> None:
    """Told by a task as it begins: what other operators remember in this Python worker goes, as Spark gives a worker to one after the other."""
    while _holders and _holders[-1][0] != name:
        _holders.pop()[1]()
    if not _holders and forget:
        _holders.append((name, forget))


def rows_and_texts(docs: DataFrame, kept: list[str], text_col: str) -> tuple[DataFrame, Callable[[pa.RecordBatch], pa.Array]]:
    """(row[, text]) of docs for a task: the kept columns in one, so that no name meets another, and how a batch gives its texts.

    A text that is kept is sent once.
    """
    row = F.struct(*[docs[c].alias(f"c{k}") for k, c in enumerate(kept)], F.lit(0).alias("unused")).alias("row")
    if text_col in kept:
        place = kept.index(text_col)
        return docs.select(row), lambda batch: batch.column("row").field(place)
    return docs.select(row, docs[text_col].alias("text")), lambda batch: batch.column("text")


def column_names(frame: DataFrame, wanted: dict[str, str]) -> DataFrame:
    """Only the wanted columns, under the names that an operator uses inside."""
    return frame.select(*[frame[have].alias(name) for name, have in wanted.items()])
