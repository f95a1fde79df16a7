"""Queries of the operators on folders, stores and workspaces, with the posts' texts as the files' contents.

A post lies at source/year/doc_id.txt. What is on disk, in the manifest or in the store differs by rules on
the posts' columns, which the SQL repeats.
"""

from __future__ import annotations

import contextlib
import io
import os
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stemma.functions import ident
from stemma.operators import manifest as M
from stemma.operators import trees
from stemma.plans.fields import IDS, _NIL
from stemma.plans.manifests import _entries, query
from stemma.runtime import remove_at_exit, shared_folder, table, written
from stemma.schema import entry_name, parent_path, path_depth
from stemma.sources import scan as S
from stemma.sources.codec import dumps
from stemma.sources.store import BlobStore, ContentNotFound, open_store, script_lines
from stemma.workspace import Workspace


def work_folder(spark: SparkSession, name: str) -> str:
    """A new place in the shared folder, as a plain path; deleted with the written tables."""
    path = os.path.join(shared_folder(spark).removeprefix("file://"), "stemma", f"{name}-{uuid.uuid4().hex}")
    remove_at_exit(spark, "file://" + path)
    return path


def _posts(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, path, content, digest, author, lang, posted_at) of all posts; the content of no text is empty."""
    d = table(spark, folder, "documents")
    path = F.concat(F.coalesce("source", F.lit("none")), F.lit("/"), F.coalesce(F.date_format("posted_at", "yyyy"), F.lit("undated")), F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt"))
    content = F.coalesce("text", F.lit("")).cast("binary")
    return d.select("doc_id", path.alias("path"), content.alias("content"), ident.digest_of(content).alias("digest"), "source", "author", "lang", "posted_at")


_POSTS = """p as (select doc_id, coalesce(source, 'none') || '/' || coalesce(strftime(make_timestamp(epoch_us(posted_at)), '%Y'), 'undated') || '/' as dir, coalesce(source, 'none') || '/' as top, doc_id || '.txt' as name,
  coalesce(text, '') as content, source, author, lang, posted_at from documents)"""


def _write(files: DataFrame, root: str) -> str:
    """(path, content) as files below root, by tasks."""

    def run(batches):
        for b in batches:
            for path, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                file = os.path.join(root, path)
                os.makedirs(os.path.dirname(file), exist_ok=True)
                with open(file, "wb") as f:
                    f.write(content)
            yield pa.RecordBatch.from_pydict({"n": pa.array([len(b)], pa.int64())})

    os.makedirs(root, exist_ok=True)
    files.select("path", "content").mapInArrow(run, "n long").agg(F.sum("n")).first()
    return root


def _listed(posts: DataFrame, manifest_id: str | None = None) -> DataFrame:
    """Manifest rows of posts, without their directories."""
    p = F.col("path")
    return posts.select(
        F.lit(manifest_id).alias("manifest_id") if manifest_id else F.coalesce("source", F.lit("none")).alias("manifest_id"), F.lit(0).alias("section_idx"), F.col("doc_id").alias("ord"), "path", parent_path(p).alias("parent"), entry_name(p).alias("name"), path_depth(p).alias("depth"),
        F.lit(False).alias("is_dir"), F.lit(0o100644).alias("mode"), F.timestamp_seconds(F.lit(1_700_000_000)).alias("ts"), F.length("content").cast("long").alias("size"), "digest", F.lit(None).cast("string").alias("target"),
        F.lit(0).alias("hard_link"), F.lit("").alias("flow_direction"), F.lit(None).cast("string").alias("flow_target"), F.lit(False).alias("is_sequence"), F.lit(None).cast("string").alias("pattern"),
    )


def _steps(spark: SparkSession, rows: list[tuple[str, int]]) -> DataFrame:
    return spark.createDataFrame([(k, int(v)) for k, v in rows], "step string, n long")


def _steps_sql(steps: dict[str, str]) -> str:
    return " union all ".join(f"select '{k}' as step, ({v})::bigint as n" for k, v in steps.items())


# --- scans


@query(
    f"with {_POSTS}, f as (select dir || name as path, name, dir as parent, 2 as depth, false as is_dir, strlen(content) as size, true as same, null as target from p)"
    " select * from f union all select distinct top, top, null, 0, true, null::bigint, null::boolean, null from p union all select distinct dir, split_part(dir, '/', 2) || '/', top, 1, true, null, null, null from p"
    " union all select 'broken', 'broken', null, 0, false, 7, true, 'nowhere' union all select 'link', 'link', null, 0, false, 4, true, 'none'"
)
def scanned_files(spark, folder):
    """All posts as files, scanned; each file's ID against that of the text."""
    posts = _posts(spark, folder)
    root = _write(posts, work_folder(spark, "files"))
    os.symlink("nowhere", os.path.join(root, "broken"))
    os.symlink("none", os.path.join(root, "link"))  # to a folder, which isn't followed
    _write(posts.limit(1).select(F.lit(".hidden/x").alias("path"), "content"), root)  # not listed
    rows = S.scan(spark, root, manifest_id="m")
    own = posts.select("path", F.col("digest").alias("_own"))
    got = rows.join(own, "path", "left").withColumn("size", F.when(~F.col("is_dir"), F.col("size")))
    return got.select("path", "name", "parent", "depth", "is_dir", "size", F.when(~F.col("is_dir"), F.col("digest").eqNullSafe(F.col("_own"))).alias("same"), "target")


@query(f"with {_POSTS} select path, case when written then 'as listed' else 'unreadable' end as found from (select dir || name as path, lang is not null as written from p)")
def identified_files(spark, folder):
    """Files by name, those of posts without a label absent: their IDs against those of the texts."""
    posts = _posts(spark, folder)
    root = _write(posts.where("lang is not null"), work_folder(spark, "files"))
    got = S.identify_files(spark, posts.select(F.concat(F.lit(root + "/"), "path").alias("file"))).select(F.substring("file", len(root) + 2, 2**31 - 1).alias("path"), F.col("digest").alias("_found"))
    found = F.when(F.col("_found").isNull(), "unreadable").when(F.col("_found") == F.col("digest"), "as listed").otherwise("different")
    return posts.join(got, "path").select("path", found.alias("found"))


@query(
    f"with {_POSTS} select dir || name as path, case when source is null then 'missing' when lang is null then 'extra' when author is null then 'corrupt' else 'ok' end as status from p where source is not null or lang is not null"
)
def verified_folder(spark, folder):
    """A folder against a manifest: posts without a source aren't on disk, those without a label not listed,
    those without an author have another content."""
    posts = _posts(spark, folder)
    wrong = F.when(F.col("author").isNull(), F.concat("content", F.lit("x").cast("binary"))).otherwise(F.col("content"))
    root = _write(posts.where("source is not null").withColumn("content", wrong), work_folder(spark, "files"))
    return trees.verify_tree(spark, _listed(posts.where("lang is not null"), "m"), root).select("path", "status")


# --- stores and bundles


@query(f"with {_POSTS}, s as (select distinct content from p where author is not null) select doc_id, s.content is not null as stored, strlen(s.content) as bytes from p left join s on p.content = s.content")
def stored_contents(spark, folder):
    """The texts of posts with an author put into a store twice, and asked for by all posts' IDs."""
    posts = _posts(spark, folder)
    store = BlobStore(spark, "file://" + work_folder(spark, "store"))
    put = posts.where("author is not null").select("content")
    store.put(put)
    if not store.put(put).isEmpty():
        raise AssertionError("contents that are there were added")
    got = written(store.get(posts.select("digest")), "got").select("digest", F.col("content").alias("_content"))
    none = store.missing(posts.select("digest")).withColumn("_none", F.lit(True))
    both = posts.join(got, "digest", "left").join(none, "digest", "left")
    # what get leaves out is what missing names, and contents are those of the posts
    stored = F.when(F.col("_content") == F.col("content"), F.col("_none").isNull()).otherwise(F.col("_none").isNull() | F.col("_content").isNotNull())
    return both.select("doc_id", stored.alias("stored"), F.length("_content").cast("long").alias("bytes"))


@query(
    f"with {_POSTS}, s as (select distinct content from p where author is not null), r as (select p.content, s.content is not null as stored from p left join s on p.content = s.content), c as (select count(*) filter (where stored) as rows, count(distinct content) filter (where stored) as texts, count(*) filter (where not stored) as gone from r) "
    + _steps_sql({"copied": "select texts from c", "skipped": "select rows - texts from c", "missing": "select gone from c", "again copied": "0", "again skipped": "select rows from c", "again missing": "select gone from c",
                  "ingested": "select texts from c", "ingested again": "0", "rejected": "1", "manifests": "select count(distinct coalesce(source, 'none')) from p", "rows of the manifests": "select count(*) + count(distinct top) + count(distinct dir) from p"})
)
def bundle_steps(spark, folder):
    """A bundle of all posts, one manifest a source, from a store with the texts that have an author; the bundle
    taken in by another store, with a file in it that lies about its ID."""
    from stemma.sources.codec import decode, read_texts

    posts = _posts(spark, folder)
    store, other = (BlobStore(spark, "file://" + work_folder(spark, n)) for n in ("store", "other"))
    store.put(posts.where("author is not null").select("content"))
    place = work_folder(spark, "bundle")
    listed = written(M.with_implied(_listed(posts)), "listed")
    first, again = (store.bundle(listed, place, leaf=64).first() for _ in range(2))
    with open(os.path.join(place, "store", ident.text_of_one(bytes(64))), "wb") as f:
        f.write(b"not of this ID")
    taken, twice = (other.ingest(place).first() for _ in range(2))
    rows = decode(read_texts(spark, f"file://{place}/*.c4m")).count() if taken.manifests else 0  # without a walk of the contents below
    steps = [("copied", first.copied), ("skipped", first.skipped), ("missing", first.missing), ("again copied", again.copied), ("again skipped", again.skipped), ("again missing", again.missing)]
    steps += [("ingested", taken.copied), ("ingested again", twice.copied), ("rejected", taken.rejected), ("manifests", len(taken.manifests)), ("rows of the manifests", rows)]
    return _steps(spark, steps)


_QUOTED = "chr(39) || replace(path, chr(39), chr(39) || '\"' || chr(39) || '\"' || chr(39)) || chr(39)"


@query(
    f"with recursive {IDS} select manifest_id, path, case when d then 'mkdir -p \"$to\"/' || {_QUOTED} else 'put ' || id || ' \"$to\"/' || {_QUOTED} end as line"
    f" from (select e.manifest_id, e.path, e.digest, coalesce(e.name like '%/', false) or coalesce((e.mode & 61440) = 16384, false) as d, ids.id from {{LAST}} e left join ids on ids.digest = e.digest) where d or digest <> {_NIL}"
)
def extraction_scripts(spark, folder):
    """The commands of the scripts that go with a bundle."""
    return script_lines(_entries(spark, folder), with_path=True)


@query(f"with {_POSTS} " + _steps_sql({"by argument": "1", "by environment": "1", "none named": "1", "file verified": "1", "not there": "1", "there": "1"}))
def opened_stores(spark, folder):
    """A store found by its argument and by the environment; errors where there is none or no such content."""
    place = "file://" + work_folder(spark, "store")
    posts = _posts(spark, folder).orderBy("doc_id").limit(1)
    content = posts.select("content", "digest").first()
    store = open_store(spark, place)
    store.put(spark.createDataFrame([(content.content,)], "content binary"))
    steps = [("by argument", store.has(bytes(content.digest)))]
    before = os.environ.pop("STEMMA_STORE", None)
    try:
        os.environ["STEMMA_STORE"] = place
        steps.append(("by environment", open_store(spark).get_one(bytes(content.digest)) == bytes(content.content)))
        del os.environ["STEMMA_STORE"]
        try:
            named = open_store(spark) is not None and os.path.exists(os.path.expanduser("~/.stemma.ini"))
        except ValueError:
            named = True
        steps.append(("none named", named))
    finally:
        if before is not None:
            os.environ["STEMMA_STORE"] = before
    place = os.path.join(_write(posts.select(F.lit("one").alias("path"), "content"), work_folder(spark, "file")), "one")
    steps.append(("file verified", S.verify_file(place, bytes(content.digest)) and not S.verify_file(place, bytes(64))))
    try:
        store.get_one(bytes(64))
        steps.append(("not there", False))
    except ContentNotFound:
        steps.append(("not there", not store.has(bytes(64))))
    steps.append(("there", store.digests().count()))
    return _steps(spark, steps)


# --- reconciling and workspaces


_JUNK = "'junk/' || source || '/old.txt'"


@query(
    f"with {_POSTS}, s as (select distinct content from p where posted_at is not null), r as (select p.*, s.content is null as lacking from p left join s on p.content = s.content), dirs as (select distinct unnest([top, dir]) as dir, lang is not null as there from p) "
    + _steps_sql({"created": "select count(*) from r where lang is null and not lacking", "updated": "select count(*) from r where lang is not null and author is null and not lacking", "missing": "select count(*) from r where (lang is null or author is null) and lacking",
                  "skipped": "select count(*) from r where lang is not null and author is not null", "removed": "select count(distinct source) from p where source is not null", "unmade": "select count(distinct source) + 1 from p where source is not null",
                  "made": "select count(*) from (select dir from dirs group by dir having not bool_or(there))", "errors": "0", "right afterwards": "select count(*) from r where not lacking or (lang is not null and author is not null)", "a second run changes": "0"})
)
def reconciled_folder(spark, folder):
    """A folder made what a manifest says: posts without a label aren't there yet, those without an author have
    another content, a file for each source is in the way; contents without a date aren't in the store."""
    posts = _posts(spark, folder)
    store = BlobStore(spark, "file://" + work_folder(spark, "store"))
    store.put(posts.where("posted_at is not null").select("content"))
    wrong = F.when(F.col("author").isNull(), F.concat("content", F.lit("x").cast("binary"))).otherwise(F.col("content"))
    junk = posts.where("source is not null").select("source").distinct().select(F.concat(F.lit("junk/"), "source", F.lit("/old.txt")).alias("path"), F.lit("old").cast("binary").alias("content"))
    root = _write(posts.where("lang is not null").select("path", wrong.alias("content")).unionByName(junk), work_folder(spark, "files"))
    target = M.with_implied(_listed(posts, "m"))
    _, done = trees.reconcile(spark, target, root, store)
    steps = [(k, done[k]) for k in ("created", "updated", "missing", "skipped", "removed", "unmade", "made", "errors")]
    steps.append(("right afterwards", trees.verify_tree(spark, target, root).where("status = 'ok'").count()))
    _, twice = trees.reconcile(spark, target, root, store)
    steps.append(("a second run changes", sum(twice[k] for k in ("created", "updated", "removed", "unmade", "made"))))
    return _steps(spark, steps)


@query(
    f"with {_POSTS}, c as (select *, author is null or lang is null as hit from p), d as (select unnest([top, dir]) as dir, hit from c) "
    + _steps_sql({"created": "select count(*) from p", "made": "select count(distinct dir) from d", "listed": "select (select count(*) from p) + (select count(distinct dir) from d)", "changes after checkout": "0",
                  "files modified": "select count(*) from p where author is null and lang is not null", "files removed": "select count(*) from p where lang is null", "directories modified": "select count(*) from (select dir from d group by dir having bool_or(hit))",
                  "reset created": "select count(*) from p where lang is null", "reset updated": "select count(*) from p where author is null and lang is not null", "stored by snapshot": "select count(distinct content) + 1 from p", "state kept": "1", "nothing to reset": "1"})
)
def workspace_steps(spark, folder):
    """All posts checked out, changed on disk, reset, and taken as a snapshot with a file more."""
    posts = _posts(spark, folder)
    source, place = _write(posts, work_folder(spark, "files")), work_folder(spark, "workspace")
    listed = written(S.scan(spark, source, manifest_id="m"), "listed")
    store, second = (BlobStore(spark, "file://" + work_folder(spark, n)) for n in ("store", "second"))
    store.put(posts.select("content"))
    try:
        Workspace(spark, work_folder(spark, "void"), store).reset()
        empty = False
    except RuntimeError:
        empty = True
    w = Workspace(spark, place, store)
    done = w.checkout(listed)
    steps = [("created", done["created"]), ("made", done["made"]), ("listed", w.current().count()), ("changes after checkout", w.changes().count())]
    other = F.concat("content", F.lit("x").cast("binary"))
    _write(posts.where("author is null and lang is not null").select("path", other.alias("content")), place)
    for r in posts.where("lang is null").select("path").toLocalIterator():
        os.unlink(os.path.join(place, r.path))
    changes = written(w.changes().select("status", "path"), "changes")
    steps += [("files modified", changes.where("status = 'modified' and path like '%.txt'").count()), ("files removed", changes.where("status = 'removed'").count()), ("directories modified", changes.where("status = 'modified' and path like '%/'").count())]
    again = Workspace(spark, place, second)
    kept = again.status()["last_checkout"] is not None and again.status()["manifest"] is not None
    back = w.reset()
    steps += [("reset created", back["created"]), ("reset updated", back["updated"])]
    with open(os.path.join(place, "more.txt"), "w") as f:
        f.write("a text of no post " + uuid.uuid4().hex)
    again.snapshot()
    steps += [("stored by snapshot", second.digests().count()), ("state kept", kept), ("nothing to reset", empty)]
    return _steps(spark, steps)


@query(
    f"with {_POSTS} "
    + _steps_sql({"id of a file": "1", "id of a folder": "1", "lines of a folder": "select count(*) + count(distinct top) + count(distinct dir) from p", "id of nothing": "1", "diff lines": "select count(*) + count(distinct dir) + count(distinct top) from p where author is null", "diff exit": "0",
                  "verify lines": "select count(*) from p where author is null", "verify exit": "1", "verify exit of the same": "0", "cat": "1", "cat of nothing": "1", "version": "1"})
)
def command_line(spark, folder):
    """The commands on two folders of all posts, of which those without an author differ."""
    from stemma import __main__ as cli
    from stemma import __version__

    posts = _posts(spark, folder)
    other = F.when(F.col("author").isNull(), F.concat("content", F.lit("x").cast("binary"))).otherwise(F.col("content"))
    a, b = _write(posts, work_folder(spark, "files")), work_folder(spark, "files")
    import shutil

    shutil.copytree(a, b)  # with the times of the files
    _write(posts.where("author is null").select("path", other.alias("content")), b)
    store = "file://" + work_folder(spark, "store")
    BlobStore(spark, store).put(posts.select("content"))
    listed = S.scan(spark, a, manifest_id="_")
    manifest = os.path.join(work_folder(spark, "manifest"), "a.c4m")
    os.makedirs(os.path.dirname(manifest))
    with open(manifest, "w") as f:
        f.write(dumps(listed))
    one = posts.where("length(content) > 0").orderBy("doc_id").select("path", "content", ident.id_text("digest").alias("id")).first()

    def run(*args: str) -> tuple[int, bytes]:
        out = io.TextIOWrapper(io.BytesIO(), encoding="utf-8", write_through=True)
        with contextlib.redirect_stdout(out), contextlib.redirect_stderr(io.StringIO()):
            status = cli.main(list(args))
        return status, out.buffer.getvalue()

    folder_id = run("id", "-i", a)
    diff, verify = run("diff", a, b), run("verify", manifest, b)
    steps = [
        ("id of a file", run("id", os.path.join(a, one.path)) == (0, one.id.encode() + b"\n")), ("id of a folder", folder_id[0] == 0 and len(folder_id[1]) == 91), ("lines of a folder", run("id", a)[1].count(b"\n")), ("id of nothing", run("id", a + "/absent")[0]),
        ("diff lines", diff[1].count(b"\n")), ("diff exit", diff[0]), ("verify lines", verify[1].count(b"corrupt ")), ("verify exit", verify[0]), ("verify exit of the same", run("verify", manifest, a)[0]),
        ("cat", run("cat", one.id, "--store", store) == (0, bytes(one.content))), ("cat of nothing", run("cat", ident.text_of_one(bytes(64)), "--store", store)[0]), ("version", run("version") == (0, __version__.encode() + b"\n")),
    ]
    return _steps(spark, steps)
