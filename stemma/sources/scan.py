"""Directory trees as a source: a Python data source with modes, links and empty directories."""

from __future__ import annotations

import collections
import hashlib
import os
import stat
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from stemma.operators.rollup import scan_metadata

FORMAT = "stemma_scan"
#: Largest file whose content fits into a row.
CONTENT_LIMIT = 2_000_000_000
SCHEMA = "path string, name string, parent string, depth int, is_dir boolean, mode int, ts timestamp, size long, digest binary, target string, file string"


def digest_of_file(file: str) -> bytes | None:
    """Digest of a file's content, canonical if it is a manifest; None if it can't be read."""
    from stemma.sources.codec import SNIFF, identified

    try:
        with open(file, "rb") as f:
            if file.endswith(".c4m") or os.fstat(f.fileno()).st_size < SNIFF:
                return hashlib.sha512(identified(f.read(), file)).digest()
            return hashlib.file_digest(f, "sha512").digest()
    except OSError:
        return None


class _Folders(InputPartition):
    """Folders to list; whole: with all below them."""

    def __init__(self, folders: list[str], whole: bool):
        self.folders, self.whole = folders, whole


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.root = os.path.abspath(options["path"])
        self.ids = options.get("computeids", "true").lower() == "true"
        self.hidden = options.get("hidden", "false").lower() == "true"
        self.follow = options.get("followsymlinks", "false").lower() == "true"
        self.contents = options.get("contents", "false").lower() == "true"
        self.per_task = int(options.get("folderspertask", "64"))
        self.spread = int(options.get("foldersspread", "4096"))
        self.tasks = int(options.get("tasks", "256"))
        if not os.path.isdir(self.root):
            raise ValueError(f"{self.root} is no directory")

    def _shown(self, name: str) -> bool:
        return self.hidden or not name.startswith(".")

    def _below(self, rel: str) -> list[str]:
        """Folders directly in a folder."""
        folder = os.path.join(self.root, rel)
        try:
            with os.scandir(folder) as entries:
                return sorted(os.path.normpath(os.path.join(rel, e.name)) for e in entries if self._shown(e.name) and e.is_dir(follow_symlinks=self.follow))
        except OSError:
            return []

    def partitions(self):
        """The driver lists folders from the top until it has enough of them to spread; what lies below the rest
        is for their tasks, each of which takes folders from all parts of the list."""
        flat, todo = [], collections.deque(["."])
        while todo and len(flat) + len(todo) < self.spread:
            flat.append(todo.popleft())
            todo.extend(self._below(flat[-1]))
        parts = [_Folders(flat[i : i + self.per_task], False) for i in range(0, len(flat), self.per_task)]
        n = min(len(todo), self.tasks)
        return parts + [_Folders(list(todo)[i::n], True) for i in range(n)]

    def read(self, partition: _Folders) -> Iterator[tuple]:
        import datetime as dt

        todo = list(partition.folders)
        while todo:
            rel = todo.pop()
            folder = os.path.normpath(os.path.join(self.root, rel))
            parent = "" if rel == "." else rel + "/"
            try:
                names = sorted(e for e in os.listdir(folder) if self._shown(e))
            except OSError:
                continue
            for name in names:
                file = os.path.join(folder, name)
                try:
                    st = os.stat(file) if self.follow else os.lstat(file)
                except OSError:
                    continue
                link, folder_row = stat.S_ISLNK(st.st_mode), stat.S_ISDIR(st.st_mode)
                slash = "/" if folder_row else ""
                if folder_row and partition.whole:
                    todo.append(parent + name)
                digest, content = None, ()
                if self.contents:
                    digest, *content = self._read_once(file) if stat.S_ISREG(st.st_mode) or (link and os.path.isfile(file)) else (None, None)
                elif self.ids and not folder_row and os.path.isfile(file):
                    digest = digest_of_file(file)
                yield (
                    parent + name + slash, name + slash, parent or None, parent.count("/"), folder_row, st.st_mode,
                    dt.datetime.fromtimestamp(int(st.st_mtime), dt.timezone.utc), None if folder_row else st.st_size, digest, os.readlink(file).replace("\\", "/") if link else None, file, *content,
                )

    @staticmethod
    def _read_once(file: str) -> tuple[bytes | None, bytes | None]:
        """(digest, content as it is identified)."""
        from stemma.sources.codec import identified

        if os.path.getsize(file) > CONTENT_LIMIT:
            raise ValueError(f"{file} is too large for the store")
        try:
            with open(file, "rb") as f:
                content = identified(f.read(), file)
        except OSError:
            return None, None
        return hashlib.sha512(content).digest(), content


class ScanSource(DataSource):
    """format("stemma_scan"), options path, computeIds, hidden, followSymlinks, foldersPerTask, foldersSpread
    (the driver lists about so many folders to spread the tree over tasks), tasks (at most so many take what lies
    below those), and contents, which adds the column content."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA + (", content binary" if {k.lower(): v for k, v in self.options.items()}.get("contents") == "true" else "")

    def reader(self, schema) -> DataSourceReader:
        return _Reader({k.lower(): v for k, v in self.options.items()})


def scan_rows(spark: SparkSession, path: str, **options) -> DataFrame:
    """Rows of the tree as read, with ``file`` the absolute name. Folders are spread over tasks, some for each
    core, so the tree must lie on a file system that all executors share."""
    spark.dataSource.register(ScanSource)
    reader = spark.read.format(FORMAT).option("path", path).option("tasks", str(8 * spark.sparkContext.defaultParallelism))
    for k, v in options.items():
        reader = reader.option(k, str(v).lower() if isinstance(v, bool) else str(v))
    return reader.load()


def scan(spark: SparkSession, path: str, manifest_id: str | None = None, compute_ids: bool = True, follow_symlinks: bool = False) -> DataFrame:
    """Manifest rows of a tree. Names starting with a dot are left out, with all below."""
    rows = scan_rows(spark, path, computeIds=compute_ids, followSymlinks=follow_symlinks)
    full = as_entries(rows, manifest_id or os.path.basename(os.path.abspath(path)))
    return scan_metadata(full) if compute_ids else full


def scan_and_store(spark: SparkSession, path: str, store, manifest_id: str) -> DataFrame:
    """scan() that adds the contents to a store. Every file is read once, for both."""
    from stemma.runtime import written

    rows = written(scan_rows(spark, path, contents=True), "scan")
    store.put(rows.select("content", "digest"), identified=True)
    return scan_metadata(as_entries(rows, manifest_id))


def as_entries(rows: DataFrame, manifest_id: str) -> DataFrame:
    """Manifest rows of what scan_rows gives."""
    return rows.select(
        F.lit(manifest_id).alias("manifest_id"), F.lit(0).alias("section_idx"), F.lit(0).cast("long").alias("ord"), "path", "parent", "name", "depth", "is_dir", "mode", "ts", "size", "digest", "target",
        F.lit(0).alias("hard_link"), F.lit("").alias("flow_direction"), F.lit(None).cast("string").alias("flow_target"), F.lit(False).alias("is_sequence"), F.lit(None).cast("string").alias("pattern"),
    )


def identify_files(spark: SparkSession, files: list[str] | DataFrame, tasks: int | None = None) -> DataFrame:
    """(file, digest) of files by name, a list or a frame (file); null for one that can't be read. Large files
    are read in pieces."""
    import pyarrow as pa

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_pydict({"file": b.column(0), "digest": pa.array([digest_of_file(f) for f in b.column(0).to_pylist()], pa.binary())})

    if isinstance(files, DataFrame):
        return files.select("file").mapInArrow(run, "file string, digest binary")
    named = spark.createDataFrame([(os.path.realpath(f),) for f in files], "file string")
    return named.repartition(tasks or max(1, min(len(files), spark.sparkContext.defaultParallelism))).mapInArrow(run, "file string, digest binary")


def verify_file(file: str, expected: bytes) -> bool:
    """Whether a file's content has an ID; a file that isn't there raises."""
    if not os.path.exists(file):
        raise FileNotFoundError(file)
    return digest_of_file(file) == expected
