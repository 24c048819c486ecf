"""Caption files to transcripts at scale, in Spark."""

from __future__ import annotations

import os
import shutil
import tempfile

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Send this package to the executors' Python workers; needed where it is not on their path already."""
    root = os.path.dirname(os.path.abspath(__file__))
    folder = tempfile.mkdtemp(prefix="cuemill-")  # of the driver, which sends the file from there
    spark.sparkContext.addPyFile(shutil.make_archive(os.path.join(folder, "cuemill"), "zip", os.path.dirname(root), os.path.basename(root)))
