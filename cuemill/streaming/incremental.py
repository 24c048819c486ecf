"""New caption files, cleaned and put in the store as they come.

The store is a table in partitions by a hash of the identity. A batch reads and rewrites only the
partitions that it meets, by dynamic partition overwrite, and leaves the mark of its number when it is
done; a batch that is marked is not done again.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from cuemill.functions.render import render_body, render_contents, render_frontmatter, unnamed
from cuemill.functions.text import classify_track, track_key, video_id
from cuemill.operators.clean import clean_tracks
from cuemill.operators.identity import video_identity
from cuemill.operators.select import best_track
from cuemill.operators.store import latest_per_identity, name_head, resolve_filenames
from cuemill.sources.shared import keep
from cuemill.sources.tracks import file_name

FILES = "path string, modificationTime timestamp, length long, content binary"
METADATA = "video_id string, title string, channel string, uploader_id string, channel_id string, duration string, upload_date string"
STORE = "channel_folder string, filename string, identity_kind string, identity string, fetched timestamp, layout string, contents string, live boolean"
#: Partitions of a store; it keeps the number that it was made with.
PARTITIONS = 64


def _partition(partitions: int) -> Column:
    """Of a row's identity; of its place where it has none."""
    place = F.xxhash64("channel_folder", "filename")
    return F.pmod(F.when(F.col("identity_kind").isNull(), place).otherwise(F.xxhash64("identity_kind", "identity")), F.lit(partitions)).cast("int")


def clean_batch(files: DataFrame, metadata: DataFrame | None = None) -> DataFrame:
    """(channel_folder, slug, collision_id, identity_kind, identity, fetched, layout, contents) of a batch of caption files.

    Of a video's files the best track is cleaned; the files of a batch are bounded, and so is what is
    known of them but their text, which is not shuffled. A video without metadata is named by its id.
    """
    name = file_name(F.col("path"))
    tracks = files.where("length > 0").select(
        video_id(name).alias("video_id"), track_key(name).alias("track_key"), F.col("modificationTime").alias("fetched"), F.decode("content", "UTF-8").alias("raw"), "path"
    )
    best = best_track(tracks.select("video_id", "track_key", "path", classify_track(F.col("raw")).alias("track_kind"))).select(F.col("path").alias("_best"))
    chosen = tracks.join(F.broadcast(best), F.col("path") == F.col("_best"), "left_semi")
    known = files.sparkSession.createDataFrame([], METADATA) if metadata is None else metadata
    own = known.select(*[f.split()[0] for f in METADATA.split(", ")])
    said = keep(clean_tracks(chosen), "cleaned").join(own, "video_id", "left")
    named = video_identity(said)
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    url = F.concat(F.lit("https://www.youtube.com/watch?v="), "video_id")
    block = render_frontmatter(F.coalesce(F.nullif("title", F.lit("")), "video_id"), url, text("channel"), text("duration"), text("upload_date"), F.col("fetched"), F.col("track_kind"), F.col("layout"))
    rows = named.select(
        "channel_folder", "slug", "collision_id", F.lit("url").alias("identity_kind"), url.alias("identity"), "fetched", "layout", render_contents(block, render_body(unnamed(F.col("turns")), F.col("layout"))).alias("contents"), "path"
    )
    return latest_per_identity(rows, "path").drop("path")


def put(files: DataFrame, store: str, batch: int, metadata: DataFrame | None = None, partitions: int = PARTITIONS) -> None:
    """Clean a batch of files into the store, unless a batch of that number is in it.

    A transcript takes the place of all of its identity, and of a file without one that has its name;
    such a file stays in its partition as a row that is not live. Failing between the rows and the
    mark, a batch is done again, on a store that has its rows, and comes out the same.
    """
    spark = files.sparkSession
    if _read(spark, f"{store}/_marks", "batch long").where(F.col("batch") == batch).count():
        return
    incoming = keep(clean_batch(files, metadata), "incoming")
    held = _read(spark, store, STORE + ", partition int").where("live")
    heads = incoming.select("channel_folder", name_head(F.col("slug")).alias("head")).distinct()
    near = held.select("channel_folder", "filename", "identity_kind", "identity", name_head(F.col("filename")).alias("head")).join(heads, ["channel_folder", "head"], "left_semi").drop("head")
    names = resolve_filenames(incoming, near).select("channel_folder", "identity_kind", "identity", "filename")
    new = incoming.join(names, ["channel_folder", "identity_kind", "identity"]).withColumn("live", F.lit(True)).withColumn("partition", _partition(partitions))
    columns = [f.split()[0] for f in STORE.split(", ")] + ["partition"]
    new = keep(new.select(*columns), "named")
    taken = held.where("identity_kind is null").join(new.select("channel_folder", "filename"), ["channel_folder", "filename"], "left_semi")
    met = [r[0] for r in new.select("partition").union(taken.select("partition")).distinct().collect()]  # at most `partitions`
    before = _read(spark, store, STORE + ", partition int").where(F.col("partition").isin(met))
    stays = before.join(new.select("identity_kind", "identity"), ["identity_kind", "identity"], "left_anti")
    ours = new.select("channel_folder", "filename", F.lit(True).alias("_taken"))
    stays = stays.join(ours, ["channel_folder", "filename"], "left").withColumn("live", F.col("live") & ~(F.col("identity_kind").isNull() & F.coalesce("_taken", F.lit(False))))
    after = keep(stays.select(*columns).unionByName(new), "partitions")
    after.repartition("partition").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("partition").parquet(store)
    spark.range(batch, batch + 1).toDF("batch").coalesce(1).write.mode("append").parquet(f"{store}/_marks")


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The table in a folder; no rows where there is none yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def read_store(spark: SparkSession, store: str) -> DataFrame:
    """The transcripts of a store."""
    return _read(spark, store, STORE + ", partition int").where("live").drop("live", "partition")


def stream_files(files: DataFrame, store: str, checkpoint: str, metadata: DataFrame | None = None, partitions: int = PARTITIONS) -> StreamingQuery:
    """Put a stream of files (path, modificationTime, length, content) in the store; what is there is taken, then the query ends."""
    return files.writeStream.foreachBatch(lambda batch, n: put(batch, store, n, metadata, partitions)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_transcripts(spark: SparkSession, source: str, store: str, checkpoint: str, files_a_batch: int = 10_000, metadata: DataFrame | None = None, partitions: int = PARTITIONS) -> StreamingQuery:
    """Clean what is new under the source and put it in the store; the last write of an identity wins. Read it with `read_store`."""
    stream = spark.readStream.format("binaryFile").schema(FILES).option("maxFilesPerTrigger", files_a_batch).option("recursiveFileLookup", "true").load(source)
    return stream_files(stream, store, checkpoint, metadata, partitions)
