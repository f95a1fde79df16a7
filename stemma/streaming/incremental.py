"""Manifests and contents that keep arriving, as streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from stemma.sources.codec import decode, decode_errors
from stemma.sources.scan import scan_rows
from stemma.sources.store import BlobStore

_BINARY = "path string, modificationTime timestamp, length long, content binary"


def _arriving_texts(spark: SparkSession, folder: str, files_per_batch: int) -> DataFrame:
    files = spark.readStream.format("binaryFile").schema(_BINARY).option("pathGlobFilter", "*.c4m").option("maxFilesPerTrigger", files_per_batch).load(folder)
    return files.select(F.regexp_extract("path", r"([^/]+)\.c4m$", 1).alias("manifest_id"), F.decode("content", "UTF-8").alias("text"))


def arriving_entries(spark: SparkSession, folder: str, files_per_batch: int = 1000) -> DataFrame:
    """Streaming entry rows of manifest files as they appear in a folder; bad files are left out, and are
    the rows of arriving_errors.

    Each file is read once; its name without the ending is the manifest's.
    """
    return decode(_arriving_texts(spark, folder, files_per_batch), errors="skip")


def arriving_errors(spark: SparkSession, folder: str, files_per_batch: int = 1000) -> DataFrame:
    """Streaming (manifest_id, message) of the files that arriving_entries leaves out."""
    return decode_errors(_arriving_texts(spark, folder, files_per_batch))


def append_manifests(spark: SparkSession, folder: str, table: str, errors: str, checkpoint: str) -> list[StreamingQuery]:
    """Appends arriving entries to one parquet folder and the names and messages of bad files to another,
    each exactly once, so that every file with an entry or a fault gives rows in one of them."""
    return [append_entries(arriving_entries(spark, folder), table, checkpoint + "/entries"), append_entries(arriving_errors(spark, folder), errors, checkpoint + "/errors")]


def append_entries(entries: DataFrame, table: str, checkpoint: str) -> StreamingQuery:
    """Appends streaming entry rows to a parquet folder, exactly once; ends when all input is read."""
    return entries.writeStream.format("parquet").option("path", table).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def changes_by_window(entries: DataFrame, width: str = "1 hour") -> DataFrame:
    """Running (window, files, bytes) by modification time, for update and complete mode.

    Listings bring times of any age, so there is no watermark: every row counts, and the state has one row
    a window that occurs. No window is ever final, so append mode is an error.
    """
    rows = entries.where("ts is not null and not is_dir")
    return rows.groupBy(F.window("ts", width)).agg(F.count(F.lit(1)).alias("files"), F.sum("size").alias("bytes"))


def fill_store(spark: SparkSession, folder: str, store: BlobStore, checkpoint: str) -> StreamingQuery:
    """Adds files as they appear in a folder to the store. A repeated batch adds nothing, as put is idempotent.

    Spark's file source passes over empty files, so their one content is added from a listing of the folder.
    """
    if not scan_rows(spark, folder.removeprefix("file://"), computeIds=False, hidden=True).where("not is_dir and target is null and size = 0").isEmpty():
        store.put(spark.createDataFrame([(bytearray(),)], "content binary"))
    files = spark.readStream.format("binaryFile").schema(_BINARY).option("recursiveFileLookup", "true").load(folder)
    return files.select("content", "path").writeStream.foreachBatch(lambda df, _: store.put(df)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
