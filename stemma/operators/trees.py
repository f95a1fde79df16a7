"""Manifests against real directory trees: verification, reconcile plans and their execution."""

from __future__ import annotations

import os

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stemma.operators.manifest import is_dir
from stemma.runtime import written
from stemma.schema import known_digest, latest
from stemma.sources.scan import digest_of_file, scan_rows
from stemma.sources.store import BlobStore

#: Sidecar files of a workspace; never removed by a reconcile.
STATE_FILES = (".stemma.json", ".stemma.c4m")


def with_file_digest(rows: DataFrame) -> DataFrame:
    """Rows with ``found``, the digest of the content of ``file``; null if it can't be read."""

    def run(batches):
        for b in batches:
            found = [digest_of_file(f) for f in b.column(b.schema.get_field_index("file")).to_pylist()]
            yield b.append_column("found", pa.array(found, pa.binary()))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", found binary"
    return rows.mapInArrow(run, schema)


def compare_content(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """(path, status, expected, actual) of two sets of (path, digest): ok, missing, corrupt or extra.

    Rows of ``expected`` without a digest aren't expected.
    """
    e = expected.where("digest is not null").select("path", F.col("digest").alias("expected"), F.lit(True).alias("_e"))
    a = actual.select("path", F.col("digest").alias("actual"), F.lit(True).alias("_a"))
    b = e.join(a, "path", "full_outer")
    status = F.when(F.col("_a").isNull(), "missing").when(F.col("_e").isNull(), "extra").when(F.col("expected").eqNullSafe(F.col("actual")), "ok").otherwise("corrupt")
    return b.select("path", status.alias("status"), "expected", "actual")


def expected_status(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """(manifest_id, path, status) of expected files: pending (not there), corrupt or there; for a file expected
    without an ID being there is enough."""
    a = actual.select("manifest_id", "path", F.col("digest").alias("_found"), F.lit(True).alias("_a"))
    status = F.when(F.col("_a").isNull(), "pending").when(F.col("digest").isNull() | (F.col("digest").eqNullSafe(F.col("_found"))), "there").otherwise("corrupt")
    return expected.join(a, ["manifest_id", "path"], "left").select("manifest_id", "path", status.alias("status"))


def verify_tree(spark: SparkSession, entries: DataFrame, folder: str) -> DataFrame:
    """(path, status, expected, actual) of a manifest's files against a folder.

    Paths are joined first; only files on both sides are read. Hidden files aren't looked at.
    Directories aren't verified.
    """
    e = latest(entries).where(~is_dir() & F.col("digest").isNotNull()).select("path", F.col("digest").alias("expected"), F.lit(True).alias("_e"))
    a = scan_rows(spark, folder, computeIds=False).where("not is_dir").select("path", "file")
    both = written(e.join(a, "path", "full_outer"), "verify")
    match = with_file_digest(both.where("_e and file is not null").select("path", "expected", "file"))
    matched = match.select("path", F.when(F.col("found").eqNullSafe(F.col("expected")), "ok").otherwise("corrupt").alias("status"), "expected", F.col("found").alias("actual"))
    one_side = both.where("_e is null or file is null").select("path", F.when(F.col("_e").isNull(), "extra").otherwise("missing").alias("status"), "expected", F.lit(None).cast("binary").alias("actual"))
    return matched.unionByName(one_side)


def verified(report: DataFrame) -> bool:
    return report.where("status <> 'ok'").isEmpty()


# Order in which operations run: directories from the top, contents, removals, directories from the bottom.
PHASES = {"mkdir": 0, "create": 1, "update": 2, "remove": 3, "rmdir": 4}


def _depth() -> Column:
    return F.length(F.regexp_replace("path", "[^/]", ""))


def reconcile_plan(target: DataFrame, present: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """(phase, depth, type, path, digest) of what turns ``present`` into ``target``; both (path, is_dir, digest).

    A file whose content the store lacks gets no operation but a row of type ``missing``. Run by phase,
    then depth (rmdir: deepest first), then path. stored: digests; without it all content is at hand.
    """
    t = target.select("path", F.coalesce("is_dir", F.lit(False)).alias("t_dir"), F.col("digest").alias("t_digest"), F.lit(True).alias("_t"))
    p = present.select("path", F.coalesce("is_dir", F.lit(False)).alias("p_dir"), F.col("digest").alias("p_digest"), F.lit(True).alias("_p"))
    b = t.join(p, "path", "full_outer")
    if stored is not None:
        # one row a digest, written, so that AQE can split the rows of content that many paths share
        lacking = written(target.where("digest is not null").select("digest").distinct().join(stored.select("digest").distinct(), "digest", "left_anti"), "lacking")
        b = b.join(lacking.select(F.col("digest").alias("t_digest"), F.lit(True).alias("_lacking")), "t_digest", "left")
    else:
        b = b.withColumn("_lacking", F.lit(None).cast("boolean"))
    make = F.col("_t").isNotNull()
    kind = (
        F.when(make & F.col("t_dir"), F.when(F.col("_p").isNull(), "mkdir"))
        .when(make & F.col("_p").isNotNull() & F.col("t_digest").eqNullSafe(F.col("p_digest")), None)
        .when(make & F.col("_lacking"), "missing")
        .when(make, F.when(F.col("_p").isNull(), "create").otherwise("update"))
        .when(F.col("p_dir"), "rmdir")
        .otherwise("remove")
    )
    phase = F.create_map(*[F.lit(x) for kv in PHASES.items() for x in kv])
    ops = b.withColumn("type", kind).where("type is not null")
    return ops.select(F.try_element_at(phase, F.col("type")).alias("phase"), _depth().cast("int").alias("depth"), "type", "path", F.col("t_digest").alias("digest"))


def reconcile(spark: SparkSession, entries: DataFrame, folder: str, store: BlobStore | None = None, dry_run: bool = False) -> tuple[DataFrame, dict]:
    """(plan, counters). Makes a folder what a manifest says; content comes from the store.

    The folder must be shared by the executors. All is done by tasks; contents are written under another name
    and renamed, so a repeated task does no harm. Errors are counted, not raised. State files stay.
    """
    target = written(latest(entries).select("path", is_dir().alias("is_dir"), "digest", "mode", "ts", "target"), "target")
    os.makedirs(folder, exist_ok=True)
    present = scan_rows(spark, folder, computeIds=False, hidden=True).where(~F.col("path").isin(*STATE_FILES)).select("path", "is_dir", "file")
    wanted = target.where("not is_dir and digest is not null").select("path")
    both = with_file_digest(present.where("not is_dir").join(wanted, "path", "left_semi")).select("path", "is_dir", F.col("found").alias("digest"))
    rest = present.join(both.select("path"), "path", "left_anti").select("path", "is_dir", F.lit(None).cast("binary").alias("digest"))
    files_without_id = target.where("not is_dir and digest is null").select("path")
    plan = reconcile_plan(target.where("is_dir or digest is not null"), both.unionByName(rest), store.digests() if store else None)
    plan = written(plan.join(files_without_id, "path", "left_anti"), "plan")  # a row without an ID says nothing about content
    counts = {r.type: r.n for r in plan.groupBy("type").agg(F.count(F.lit(1)).alias("n")).collect()}
    done = {"created": 0, "updated": 0, "removed": 0, "made": 0, "unmade": 0, "missing": counts.get("missing", 0), "errors": 0}
    done["skipped"] = target.where("not is_dir and digest is not null").count() - counts.get("create", 0) - counts.get("update", 0) - done["missing"]
    if dry_run:
        return plan, done

    def attempt(rows: DataFrame, good: str, action, gone_is_good: bool = False) -> None:
        """Has tasks run an action on rows; counts those that succeeded, and errors."""

        def run(batches):
            for b in batches:
                ok = []
                for row in b.to_pylist():
                    try:
                        action(os.path.join(folder, row["path"]), row)
                        ok.append(True)
                    except FileNotFoundError:
                        ok.append(gone_is_good)  # a task that runs again finds it done
                    except OSError:
                        ok.append(False)
                yield pa.RecordBatch.from_pydict({"ok": pa.array(ok, pa.bool_())})

        got = rows.mapInArrow(run, "ok boolean").agg(F.count_if("ok").alias("ok"), F.count_if(F.expr("not ok")).alias("bad")).first()
        if good:
            done[good] += got.ok
            done["errors"] += got.bad

    def of(kind: str) -> DataFrame:
        return plan.where(F.col("type") == kind)

    def deepest_first(rows: DataFrame) -> list[DataFrame]:
        """Rows by depth; what is above waits for what is below. As many steps as there are levels."""
        at = sorted((r.depth for r in rows.select("depth").distinct().collect()), reverse=True)
        return [rows.where(F.col("depth") == d) for d in at]

    if counts.get("mkdir"):
        attempt(of("mkdir").select("path"), "made", lambda file, _: os.makedirs(file, exist_ok=True))
    if store:
        for kind, counter in (("create", "created"), ("update", "updated")):
            if counts.get(kind):
                todo = of(kind).select("path", "digest")
                attempt(todo.join(store.get(todo.select("digest")), "digest").select("path", "content"), counter, _write_content)
    if counts.get("remove"):
        attempt(of("remove").select("path"), "removed", lambda file, _: os.unlink(file), gone_is_good=True)
    if counts.get("rmdir"):
        for level in deepest_first(of("rmdir")):
            attempt(level.select("path"), "unmade", lambda file, _: os.rmdir(file), gone_is_good=True)
    # modes and times of what is there: contents first, directories from the bottom, so that their times stay
    marked = target.where("target is null and (mode is not null or ts is not null)").select("path", "is_dir", "mode", F.unix_micros("ts").alias("us"), _depth().cast("int").alias("depth"))
    attempt(marked.where("not is_dir"), "", _mark)
    for level in deepest_first(marked.where("is_dir")):
        attempt(level, "", _mark)
    return plan, done


def _write_content(file: str, row: dict) -> None:
    from stemma.sources.store import _write_whole

    os.makedirs(os.path.dirname(file) or ".", exist_ok=True)
    _write_whole(file, row["content"])


def _mark(file: str, row: dict) -> None:
    if row["mode"]:
        os.chmod(file, row["mode"] & 0o7777)
    if row["us"] is not None:
        os.utime(file, ns=(row["us"] * 1000, row["us"] * 1000))


def store_missing(entries: DataFrame, stored: DataFrame) -> DataFrame:
    """Distinct digests of entries that are not stored."""
    return entries.where(known_digest(F.col("digest"))).select("digest").distinct().join(stored.select("digest").distinct(), "digest", "left_anti")


def pool_counts(entries: DataFrame, stored: DataFrame) -> DataFrame:
    """(manifest_id, copied, skipped, missing) of exporting each manifest's content to an empty folder.

    Directories don't count. Rows of one digest are counted before the join, so a frequent digest is one row of it.
    """
    want = entries.where(~is_dir() & known_digest(F.col("digest"))).groupBy("manifest_id", "digest").agg(F.count(F.lit(1)).alias("n"))
    s = want.join(stored.where(known_digest(F.col("digest"))).select("digest").distinct().withColumn("_s", F.lit(True)), "digest", "left")
    return s.groupBy("manifest_id").agg(
        F.count("_s").alias("copied"), F.coalesce(F.sum(F.when(F.col("_s"), F.col("n") - 1)), F.lit(0)).alias("skipped"), F.coalesce(F.sum(F.when(F.col("_s").isNull(), F.col("n"))), F.lit(0)).alias("missing")
    )
