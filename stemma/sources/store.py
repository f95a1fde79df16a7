"""Deduplicated content, keyed by digest."""

from __future__ import annotations

import configparser
import hashlib
import os

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stemma.functions.ident import digest_of
from stemma.schema import known_digest, latest
from stemma.sources.codec import identified, identified_bytes

CONFIG = "~/.stemma.ini"


class ContentNotFound(KeyError):
    """The store has no such digest."""


class BlobStore:
    """A parquet table (digest, content, size) partitioned by the digest's first byte.

    Any folder that Spark can write to. Files are added by Spark's committer, never changed. One writer at
    a time: two at once could both add a digest they lack, which reads take as one.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def table(self) -> DataFrame:
        schema = "digest binary, content binary, size long, prefix string"
        try:
            return self.spark.read.schema(schema).parquet(self.folder)
        except Exception as e:
            if "PATH_NOT_FOUND" in str(e):
                return self.spark.createDataFrame([], schema)
            raise

    def digests(self) -> DataFrame:
        """Digests only; content isn't read."""
        return self.table().select("prefix", "digest").distinct()

    def put(self, contents: DataFrame, identified: bool = False) -> DataFrame:
        """Adds the contents (content) that the store lacks; returns (digest, size) of the added ones.

        Manifests are stored in canonical form. Repeated contents are added once. Null isn't content. A column
        path names the files, so that contents get the digests that scan gives them. identified: the contents
        are in that form already, with their digest.
        """
        from stemma.runtime import written

        rows = contents.where("content is not null")
        if not identified:
            path = F.col("path") if "path" in contents.columns else F.lit(None).cast("string")
            # plain content stays in the JVM; only what can begin a manifest is looked into
            likely = F.decode(F.substring("content", 1, 200), "ISO-8859-1").rlike(r"^[ \t\n\x0B\f\r]*([-dlpsbcrw]|$)")
            rows = rows.select(F.when(likely, identified_bytes("content", path)).otherwise(F.col("content")).alias("content"))
            rows = rows.withColumn("digest", digest_of(F.col("content")))
        rows = rows.select("content", "digest").withColumn("prefix", F.lower(F.hex(F.substring("digest", 1, 1))))
        # written first, so that what is reported is what was added
        new = written(rows.dropDuplicates(["digest"]).join(self.digests().select("digest"), "digest", "left_anti"), "put")
        rows = new.select("digest", "content", F.length("content").cast("long").alias("size"), "prefix")
        # a prefix's rows together: else each task adds a file to every prefix
        rows.hint("rebalance", "prefix").write.mode("append").partitionBy("prefix").parquet(self.folder)
        return new.select("digest", F.length("content").cast("long").alias("size"))

    def get(self, wanted: DataFrame) -> DataFrame:
        """(digest, content) of wanted digests; those missing are left out (see missing)."""
        w = wanted.select("digest").distinct().withColumn("prefix", F.lower(F.hex(F.substring("digest", 1, 1))))
        return self.table().join(w, ["prefix", "digest"], "left_semi").dropDuplicates(["digest"]).select("digest", "content")

    def get_one(self, digest: bytes) -> bytes:
        row = self.table().where((F.col("prefix") == digest[:1].hex()) & (F.col("digest") == F.lit(digest))).select("content").first()
        if row is None:
            raise ContentNotFound(digest.hex())
        return bytes(row.content)

    def has(self, digest: bytes) -> bool:
        return not self.table().where((F.col("prefix") == digest[:1].hex()) & (F.col("digest") == F.lit(digest))).select("digest").isEmpty()

    def missing(self, wanted: DataFrame) -> DataFrame:
        """Distinct non-null digests of ``wanted`` that the store lacks."""
        w = wanted.where("digest is not null").select("digest").distinct().withColumn("prefix", F.lower(F.hex(F.substring("digest", 1, 1))))
        return w.join(self.digests(), ["prefix", "digest"], "left_anti").select("digest")

    # --- bundles: folders with the contents named by ID, the manifests and a script for each

    def export(self, entries: DataFrame, folder: str, leaf: int | None = None) -> DataFrame:
        """Writes the contents of files to ``folder``, one file an ID; returns (copied, skipped, missing).

        Directories and rows without an ID or with that of nothing don't count. skipped: rows whose ID repeats
        or whose file is there. leaf: files go below folders named by pairs of the ID's characters, as many as
        leave at most so many files in one. The folder must be shared by the executors.
        """
        from stemma.functions.ident import id_text, try_digest
        from stemma.operators.manifest import is_dir
        from stemma.runtime import written

        os.makedirs(folder, exist_ok=True)
        want = entries.where(~is_dir() & known_digest(F.col("digest"))).groupBy("digest").agg(F.count(F.lit(1)).alias("n"))
        have = self._named_files(folder).select(try_digest("named").alias("digest")).where("digest is not null").distinct().withColumn("_there", F.lit(True))
        state = want.join(have, "digest", "left").join(self.digests().select("digest").withColumn("_stored", F.lit(True)), "digest", "left")
        state = state.select("digest", "n", F.coalesce("_there", F.lit(False)).alias("there"), F.coalesce("_stored", F.lit(False)).alias("stored"))
        state = written(state.withColumn("id", id_text("digest")), "export")
        todo = written(_placed(state.where("stored and not there").select("digest", "id"), leaf), "placed")

        def run(batches):
            for b in batches:
                for place, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                    file = os.path.join(folder, place)
                    os.makedirs(os.path.dirname(file), exist_ok=True)
                    _write_whole(file, content)
                yield pa.RecordBatch.from_pydict({"n": pa.array([len(b)], pa.int64())})

        if not todo.isEmpty():
            found = self.table().select("digest", "content").join(todo, "digest").dropDuplicates(["digest"])
            found.select("place", "content").mapInArrow(run, "n long").agg(F.sum("n")).first()
        return state.agg(
            F.count_if(F.expr("stored and not there")).alias("copied"),
            F.coalesce(F.sum(F.when(F.col("there"), F.col("n")).when(F.col("stored"), F.col("n") - 1)), F.lit(0)).alias("skipped"),
            F.coalesce(F.sum(F.when(~F.col("stored") & ~F.col("there"), F.col("n"))), F.lit(0)).alias("missing"),
        )

    def _named_files(self, folder: str) -> DataFrame:
        """(path, named) of the files below a folder that are named like an ID, empty ones among them."""
        from stemma.sources.scan import scan_rows

        files = scan_rows(self.spark, folder, computeIds=False).where("not is_dir").select(F.col("file").alias("path"), F.col("name").alias("named"))
        return files.where(F.col("named").rlike(r"^c4[1-9A-HJ-NP-Za-km-z]{88}\z"))

    def bundle(self, entries: DataFrame, folder: str, leaf: int | None = 4096) -> DataFrame:
        """export() to ``folder``/store, with the manifests and for each a script that copies the contents to
        their places, for use without this package; returns the counts of export."""
        from stemma.sources.codec import write_files, write_texts

        counts = self.export(entries, os.path.join(folder, "store"), leaf)
        write_texts(entries, folder).agg(F.sum("lines")).first()
        write_files(script_lines(entries), folder, ".sh", SCRIPT_HEAD).agg(F.sum("lines")).first()
        return counts

    def ingest(self, folder: str) -> DataFrame:
        """Adds files named by ID whose content has that ID; returns (copied, skipped, rejected, manifests), the
        last the names of the manifests that lie beside them (see codec.read_texts)."""
        from stemma.functions.ident import try_digest
        from stemma.runtime import written

        named = self._named_files(folder).select(try_digest("named").alias("digest"), "path")
        # every file is read once: what is counted is what is stored
        rows = written(named.mapInArrow(_verified, "digest binary, good boolean, content binary"), "ingest")
        n_all, n_good = rows.agg(F.count(F.lit(1)), F.count_if("good")).first()
        good = rows.where("good").select("content", "digest")
        copied = 0 if self.missing(good).isEmpty() else self.put(good, identified=True).count()
        return self.spark.createDataFrame([(copied, n_good - copied, n_all - n_good, manifests_beside(folder))], "copied long, skipped long, rejected long, manifests array<string>")


def manifests_beside(folder: str) -> list[str]:
    """Names of the manifests directly in a folder, without those that Spark's readers pass over: hidden and empty
    ones. What lies below, such as a bundle's contents, isn't listed."""
    with os.scandir(folder) as entries:
        names = [e.name for e in entries if e.name.endswith(".c4m") and e.is_file() and e.stat().st_size]
    return sorted(n for n in names if n[0] != "." and (n[0] != "_" or "=" in n or n.startswith(("_metadata", "_common_metadata"))))


def _verified(batches):
    """(digest, good, content) of (digest, path): whether the file has that ID, and if so its content as it is
    identified."""
    schema = pa.schema([("digest", pa.binary()), ("good", pa.bool_()), ("content", pa.binary())])
    held, size = [], 0
    for b in batches:
        for digest, path in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            with open(path, "rb") as f:
                content = f.read()
            # named by its bytes as they are: a file without the ending; else the file it was can have had it
            content = identified(content, path if hashlib.sha512(content).digest() == digest else None)
            good = hashlib.sha512(content).digest() == digest
            if held and (len(held) >= 1024 or size + len(content) > 16_000_000):
                yield pa.RecordBatch.from_pylist(held, schema=schema)
                held, size = [], 0
            held.append({"digest": digest, "good": good, "content": content if good else None})
            size += len(content)
    if held:
        yield pa.RecordBatch.from_pylist(held, schema=schema)


def _placed(ids: DataFrame, leaf: int | None) -> DataFrame:
    """(digest, place): place of each ID's file, below as many folders as it takes."""
    if leaf is None:
        return ids.select("digest", F.col("id").alias("place"))
    depth, levels, n = F.lit(0), [], ids.count()
    while n > leaf:  # a level divides by about 3364 after the first one, which all IDs share
        k = 2 * len(levels) + 2
        level = ids.groupBy(F.substring("id", 1, k - 2).alias(f"_p{k}")).agg(F.count(F.lit(1)).alias(f"_n{k}"))
        n = level.agg(F.max(f"_n{k}")).first()[0]
        if n > leaf:
            levels.append((k, level))
    for k, level in levels:
        ids = ids.withColumn(f"_p{k}", F.substring("id", 1, k - 2)).join(level, f"_p{k}").drop(f"_p{k}")
        depth = F.when(F.col(f"_n{k}") > leaf, k).otherwise(depth)
    folders = F.when(depth == 0, "").otherwise(F.regexp_replace(F.substring("id", F.lit(1), depth), "(..)", "$1/"))
    return ids.select("digest", F.concat(folders, "id").alias("place"))


SCRIPT_HEAD = """#!/bin/sh
# Copies the contents in store/ to their places below a folder, by default this one.
set -e
from=$(dirname "$0")/store
to=${1:-.}
put() {  # ID, place: follows the folders named by pairs of the ID's characters as far as there are any
  dir=$from rest=$1
  while pair=$(printf %.2s "$rest"); [ -n "$pair" ] && [ -d "$dir/$pair" ]; do dir=$dir/$pair rest=${rest#??}; done
  mkdir -p "$(dirname "$2")"
  if [ -f "$dir/$1" ]; then cp "$dir/$1" "$2"; else echo "no content for $2" >&2; fi
}
"""


def script_lines(entries: DataFrame, with_path: bool = False) -> DataFrame:
    """(manifest_id, line): commands of the extraction scripts, partitioned by manifest, by path; with_path: and
    the path."""
    from stemma.functions.ident import id_text
    from stemma.operators.manifest import is_dir

    quoted = F.concat(F.lit("'"), F.replace("path", F.lit("'"), F.lit("'\"'\"'")), F.lit("'"))
    target = F.concat(F.lit('"$to"/'), quoted)
    text = id_text("digest")
    copy = F.concat(F.lit("put "), text, F.lit(" "), target)
    line = F.when(is_dir(), F.concat(F.lit("mkdir -p "), target)).when(known_digest(F.col("digest")), copy)
    rows = latest(entries).select("manifest_id", "path", line.alias("line")).where("line is not null")
    return rows if with_path else rows.repartition("manifest_id").sortWithinPartitions("manifest_id", "path").select("manifest_id", "line")


def _write_whole(file: str, content: bytes) -> None:
    tmp = f"{file}.part{os.getpid()}"
    with open(tmp, "wb") as f:
        f.write(content)
        f.flush()
        os.fsync(f.fileno())
    os.replace(tmp, file)


def open_store(spark: SparkSession, folder: str | None = None) -> BlobStore:
    """Store at ``folder``, else at $STEMMA_STORE, else at [store] path of the configuration file."""
    folder = folder or os.environ.get("STEMMA_STORE")
    if not folder:
        config = configparser.ConfigParser()
        config.read(os.path.expanduser(CONFIG))
        folder = config.get("store", "path", fallback=None)
    if not folder:
        raise ValueError("no store is named")
    return BlobStore(spark, folder)
