"""Session helpers shared by all operators."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_local_root: list[str] = []
_tables: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """Folder every executor can reach, as named in ``spark.checkpoint.dir``.

    A temporary folder is used only if the setting is absent *and* the session runs in one
    process (tests); on a cluster an absent setting is an error rather than a silent use of a
    machine-local folder.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        if spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not _local_root:
        root = tempfile.mkdtemp(prefix="stemma-")
        _local_root.append(root)
        atexit.register(shutil.rmtree, root, ignore_errors=True)
    return "file://" + _local_root[0]


def prepare(spark: SparkSession) -> None:
    """Session settings that right results need.

    Spark 4.1 lets a union keep the partitioning its inputs were planned with, and then leaves out the
    shuffle of an aggregate above it. If AQE turns a join below into another one at run time, the inputs
    no longer have that partitioning and a key's rows stay apart, which gives wrong groups. Off, such an
    aggregate has its shuffle, by all its keys, which also keeps a frequent join key from being one task.
    """
    spark.conf.set("spark.sql.unionOutputPartitioning", "false")


def written(df: DataFrame, name: str, partition_by: tuple[str, ...] = ()) -> DataFrame:
    """``df`` written as a parquet table in the shared folder and read back.

    Cuts the lineage so that a lost executor costs a re-read, not a re-run, and fixes the rows
    where several later steps must see the same ones. partition_by: columns that later steps filter by.
    """
    spark = df.sparkSession
    prepare(spark)
    path = os.path.join(shared_folder(spark), "stemma", f"{name}-{uuid.uuid4().hex}")
    remove_at_exit(spark, path)
    df.write.option("compression", "zstd").partitionBy(*partition_by).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove_at_exit(spark: SparkSession, path: str) -> None:
    """Has clear() delete a folder; it runs when the session stops or the process ends."""
    if not _tables:
        _clear_before_stop(spark)
    _tables.append(path)


def clear(spark: SparkSession) -> None:
    """Deletes the tables this process wrote to the shared folder, through the file system that holds it.
    Frames made from them can't be read any more."""
    while _tables:
        path = spark._jvm.org.apache.hadoop.fs.Path(_tables.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def _clear_before_stop(spark: SparkSession) -> None:
    context = spark.sparkContext
    if getattr(context, "_stemma_clears", False):
        return
    stop = context.stop

    def quietly():
        try:
            if context._jsc is not None:
                clear(spark)
        except Exception:  # the JVM may be gone already
            _tables.clear()

    def clearing_stop():
        quietly()
        stop()

    context.stop, context._stemma_clears = clearing_stop, True
    atexit.register(quietly)


def ship(spark: SparkSession) -> None:
    """Sends this package to the workers, once a context, so that they need no copy of their own."""
    prepare(spark)
    context = spark.sparkContext
    if getattr(context, "_stemma_shipped", False):
        return
    package = Path(__file__).parent
    folder = tempfile.mkdtemp(prefix="stemma-code-")  # only the driver reads it; Spark distributes the file
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    archive = os.path.join(folder, "stemma.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, f.relative_to(package.parent))
    context.addPyFile(archive)
    context._stemma_shipped = True


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")
