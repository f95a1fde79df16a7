"""Directory trees: scan, verify, reconcile, store, bundles, workspace, command line."""

import hashlib
import os
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from stemma.functions.base58 import id_text
from stemma.operators import trees
from stemma.sources.codec import decode, read_texts
from stemma.sources.scan import identify_files, scan, scan_rows, verify_file
from stemma.sources.store import BlobStore, ContentNotFound, open_store
from stemma.streaming.incremental import fill_store
from stemma.workspace import Workspace

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def sha(b):
    return hashlib.sha512(b).digest()


def build(root, files):
    for name, content in files.items():
        p = root / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(content)
    return root


FILES = {"readme.txt": b"Hello world", "data.bin": b"\0\1\2\3", "src/main.py": b"main", "src/util.py": b"util", "src/lib/core.py": b"core", "_under/x": b"u", "other/main.py": b"other main"}


def test_scan(spark, tmp_path):
    root = build(tmp_path / "t", FILES | {".hidden": b"h", ".git/config": b"c"})
    (root / "empty").mkdir()
    os.symlink("readme.txt", root / "link")
    os.symlink("nowhere", root / "broken")
    rows = {r.path: r for r in scan(spark, str(root)).collect()}
    assert rows.keys() == {*FILES, "src/", "src/lib/", "_under/", "other/", "empty/", "link", "broken"}
    for name, content in FILES.items():
        assert bytes(rows[name].digest) == sha(content) and rows[name].size == len(content)
    assert rows["link"].target == "readme.txt" and bytes(rows["link"].digest) == sha(b"Hello world") and rows["broken"].digest is None
    assert rows["empty/"].size == 0 and bytes(rows["empty/"].digest) == sha(b"") and rows["empty/"].ts is not None
    assert rows["src/main.py"].parent == "src/" and rows["src/lib/core.py"].depth == 2
    assert scan(spark, str(root), compute_ids=False).where("digest is not null").count() == 0
    few = scan_rows(spark, str(root), foldersSpread=2)  # most folders are found by the tasks
    assert {r.path for r in few.collect()} == rows.keys()
    (tmp_path / "void").mkdir()
    assert scan(spark, str(tmp_path / "void")).count() == 0
    with pytest.raises(Exception, match="no directory"):
        scan(spark, str(root / "readme.txt")).count()


def test_manifest_files_are_identified_in_canonical_form(spark, tmp_path):
    root = build(tmp_path / "t", {"a.c4m": b"  - - 1 b -\n- - 2 a -\n", "b.c4m": b"- - 2 a -\n- - 1 b -\n", "c.txt": b"- - 2 a -\n- - 1 b -\n"})
    assert len({bytes(r.digest) for r in scan(spark, str(root)).collect()}) == 1


def test_verify(spark, tmp_path):
    root = build(tmp_path / "t", FILES)
    m = scan(spark, str(root)).cache()
    assert trees.verified(trees.verify_tree(spark, m, str(root)))
    (root / "readme.txt").write_bytes(b"tampered")
    (root / "data.bin").unlink()
    build(root, {"new.txt": b"n", ".hidden": b"h"})
    got = {r.path: r.status for r in trees.verify_tree(spark, m, str(root)).collect()}
    assert {p: s for p, s in got.items() if s != "ok"} == {"readme.txt": "corrupt", "data.bin": "missing", "new.txt": "extra"}


def contents(spark, *cs):
    return spark.createDataFrame([(None if c is None else bytearray(c),) for c in cs], "content binary")


def test_store(spark, tmp_path):
    s = BlobStore(spark, "file://" + str(tmp_path / "store"))
    assert s.digests().count() == 0 and not s.has(sha(b"a"))
    assert s.put(contents(spark, b"a", b"a", b"b", b"", None)).count() == 3
    assert s.put(contents(spark, b"a", b"c")).count() == 1
    assert s.get_one(sha(b"")) == b"" and s.has(sha(b"c"))
    with pytest.raises(ContentNotFound):
        s.get_one(sha(b"zz"))
    want = spark.createDataFrame([(bytearray(sha(b"a")),), (bytearray(sha(b"zz")),), (bytearray(sha(b"a")),), (None,)], "digest binary")
    assert [bytes(r.content) for r in s.get(want).collect()] == [b"a"]
    assert [bytes(r.digest) for r in s.missing(want).collect()] == [sha(b"zz")]
    with pytest.raises(ValueError):
        open_store(spark)


def test_bundles(spark, tmp_path):
    root = build(tmp_path / "t", FILES | {"copy": b"main"})
    m = scan(spark, str(root)).where("not is_dir").cache()
    s = BlobStore(spark, "file://" + str(tmp_path / "store"))
    s.put(contents(spark, *[c for n, c in FILES.items() if n != "data.bin"]))
    out = tmp_path / "bundle"
    assert tuple(s.export(m, str(out)).first()) == (6, 1, 1)
    assert (out / id_text(sha(b"main"))).read_bytes() == b"main"
    assert tuple(s.export(m, str(out)).first()) == (0, 7, 1)
    t = BlobStore(spark, "file://" + str(tmp_path / "other"))
    (out / id_text(sha(b"liar"))).write_bytes(b"truth")
    assert tuple(t.ingest(str(out)).first()) == (6, 0, 1, [])
    assert tuple(t.ingest(str(out)).first()) == (0, 6, 1, [])
    counts = trees.pool_counts(m, s.digests().select("digest")).first()
    assert (counts.copied, counts.skipped, counts.missing) == (6, 1, 1)


def test_many_small_folders_take_few_tasks(spark, tmp_path):
    files = {f"{i}/{j}/{k}": b"%d" % (i * j * k) for i in range(12) for j in range(12) for k in range(2)}
    root = build(tmp_path / "t", files)
    for spread in (1, 20, 100):  # so many folders are listed first, the rest by the tasks
        rows = scan_rows(spark, str(root), foldersSpread=spread)
        folders = {f"{i}/" for i in range(12)} | {f"{i}/{j}/" for i in range(12) for j in range(12)}
        assert sorted(r.path for r in rows.collect()) == sorted(files.keys() | folders)
        assert scan_rows(spark, str(root), foldersSpread=spread, tasks=5).rdd.getNumPartitions() <= 5 + -(-spread // 64)


def test_bundle_of_many_folders(spark, tmp_path):
    texts = [b"text %d" % i for i in range(300)]
    s = BlobStore(spark, "file://" + str(tmp_path / "store"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # as with tables that aren't small
    assert s.put(contents(spark, *texts)).count() == 300
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(list((tmp_path / "store").rglob("*.parquet"))) == len({sha(t)[0] for t in texts})  # a file a prefix
    rows = spark.createDataFrame([("m", f"f{i}", bytearray(sha(t))) for i, t in enumerate(texts)], "manifest_id string, path string, digest binary").withColumns({"name": F.col("path"), "mode": F.lit(0o100644)})
    place = tmp_path / "bundle"
    assert tuple(s.export(rows, str(place / "store"), leaf=1).first()) == (300, 0, 0)
    for name in ("m.c4m", ".h.c4m", "_h.c4m", "empty.c4m"):
        (place / name).write_bytes(b"" if name == "empty.c4m" else b"- - 1 a -\n")
    (place / "d.c4m").mkdir()
    (place / "d.c4m/n.c4m").write_bytes(b"")
    t = BlobStore(spark, "file://" + str(tmp_path / "other"))
    assert tuple(t.ingest(str(place)).first()) == (300, 0, 0, ["m.c4m"])
    assert tuple(t.ingest(str(place)).first()) == (0, 300, 0, ["m.c4m"])
    assert sorted(bytes(r.content) for r in t.table().collect()) == sorted(texts)


def test_files_by_name(spark, tmp_path):
    root = build(tmp_path / "t", FILES)
    got = {os.path.basename(r.file): r.digest and bytes(r.digest) for r in identify_files(spark, [str(root / "readme.txt"), str(root / "none")]).collect()}
    assert got == {"readme.txt": sha(b"Hello world"), "none": None}
    assert verify_file(str(root / "readme.txt"), sha(b"Hello world")) and not verify_file(str(root / "data.bin"), sha(b""))
    with pytest.raises(FileNotFoundError):
        verify_file(str(root / "none"), sha(b""))


def test_extraction_script(spark, tmp_path):
    root = build(tmp_path / "t", {"a b/it's": b"1", "c": b"2"})
    m = scan(spark, str(root)).cache()
    s = BlobStore(spark, "file://" + str(tmp_path / "store"))
    s.put(contents(spark, b"1", b"2"))
    assert tuple(s.bundle(m, str(tmp_path / "bundle"), leaf=1).first()) == (2, 0, 0)  # directories don't count
    placed = [p.relative_to(tmp_path / "bundle/store").as_posix() for p in (tmp_path / "bundle/store").rglob("c4*") if p.is_file()]
    assert all(p.replace("/", "") == i[: len(p) - 90 - p.count("/")] + i for p in placed for i in [p[-90:]]) and all("/" in p for p in placed)
    assert decode(read_texts(spark, str(tmp_path / "bundle"))).count() == 3
    subprocess.run(["sh", str(tmp_path / "bundle/t.sh"), str(tmp_path / "out")], check=True, timeout=60)
    t = BlobStore(spark, "file://" + str(tmp_path / "other"))
    assert tuple(t.ingest(str(tmp_path / "bundle")).first()) == (2, 0, 0, ["t.c4m"])
    assert (tmp_path / "out/a b/it's").read_bytes() == b"1" and (tmp_path / "out/c").read_bytes() == b"2"


def test_reconcile(spark, tmp_path):
    a, b = build(tmp_path / "a", FILES), build(tmp_path / "b", {"readme.txt": b"old", "src/main.py": b"main", "junk/x/y": b"j", ".stemma.json": b"{}"})
    m = scan(spark, str(a)).cache()
    s = BlobStore(spark, "file://" + str(tmp_path / "store"))
    s.put(contents(spark, *[c for n, c in FILES.items() if n != "data.bin"]))
    plan, dry = trees.reconcile(spark, m, str(b), s, dry_run=True)
    kinds = sorted((r.type, r.path) for r in plan.collect())
    assert ("missing", "data.bin") in kinds and ("update", "readme.txt") in kinds and ("rmdir", "junk/x/") in kinds and ("mkdir", "src/lib/") in kinds and not any(p == "src/main.py" for _, p in kinds)
    assert (b / "readme.txt").read_bytes() == b"old"
    _, done = trees.reconcile(spark, m, str(b), s)
    assert (done["created"], done["updated"], done["removed"], done["unmade"], done["missing"], done["skipped"], done["errors"]) == (4, 1, 1, 2, 1, 1, 0)
    assert {r.path for r in trees.verify_tree(spark, m, str(b)).where("status <> 'ok'").collect()} == {"data.bin"}
    assert int(os.stat(b / "src").st_mtime) == int(os.stat(a / "src").st_mtime) and (b / ".stemma.json").exists()


def test_workspace(spark, tmp_path):
    one, two = build(tmp_path / "1", {"a": b"A", "b": b"B", "sub/c": b"C"}), build(tmp_path / "2", {"a": b"A", "d": b"D"})
    s = BlobStore(spark, "file://" + str(tmp_path / "store"))
    s.put(contents(spark, b"A", b"B", b"C", b"D"))
    w = Workspace(spark, str(tmp_path / "w"), s)
    with pytest.raises(RuntimeError):
        w.reset()
    w.checkout(scan(spark, str(one)).cache())
    assert sorted(os.listdir(w.folder)) == [".stemma.c4m", ".stemma.json", "a", "b", "sub"]
    assert w.changes().count() == 0
    (tmp_path / "w/a").write_bytes(b"changed")
    (tmp_path / "w/new").write_bytes(b"n")
    assert {r.path: r.status for r in w.changes().where("not path like '%/'").collect()} == {"a": "modified", "new": "added"}
    assert {r.path for r in w.snapshot().collect()} == {"a", "b", "new", "sub/", "sub/c"} and s.has(sha(b"changed"))
    w.reset()
    assert (tmp_path / "w/a").read_bytes() == b"A" and not (tmp_path / "w/new").exists()
    again = Workspace(spark, w.folder, s)
    assert again.checkout(scan(spark, str(two)).cache())["created"] == 1
    assert sorted(x for x in os.listdir(w.folder) if x[0] != ".") == ["a", "d"] and again.status()["manifest"]
    (tmp_path / "w/.stemma.json").write_text("not json")
    assert Workspace(spark, w.folder).state == {}


def run(*args):
    return subprocess.run([sys.executable, "-m", "stemma", *args], cwd=REPO, capture_output=True, text=True, timeout=300)


def test_command_line(tmp_path):
    root = build(tmp_path / "t", {"a": b"foo", "d/b": b"bar"})
    r = run("id", str(root / "a"))
    assert r.returncode == 0 and r.stdout.strip() == id_text(sha(b"foo"))
    assert run("id", str(tmp_path / "none")).returncode == 1 and run("version").returncode == 0
    text = run("id", str(root)).stdout
    m = tmp_path / "m.c4m"
    m.write_text(text)
    assert len(text.splitlines()) == 3
    assert run("verify", str(m), str(root)).returncode == 0
    (root / "a").write_bytes(b"x")
    (root / "e").write_bytes(b"e")
    r = run("diff", str(m), str(root))
    assert r.returncode == 0 and {"~ a", "+ e"} <= set(r.stdout.splitlines())
    assert run("verify", str(m), str(root)).returncode == 1


def test_large_manifests_have_one_digest(spark, tmp_path):
    large = b"- - 2 b -\n" + b" " * 10_000_000 + b"\n- - 1 a -\n"  # not canonical, above the size that is looked into
    canonical = b"- - 1 a -\n- - 2 b -\n"
    w = Workspace(spark, str(tmp_path / "w"), BlobStore(spark, "file://" + str(tmp_path / "store")))
    build(tmp_path / "w", {"big.c4m": large, "big.txt": large, "edge.txt": b"- - 3 c -" + b" " * 9_999_980 + b"\n- - 1 a -\n"})
    listed = w.snapshot().cache()
    digests = {r.path: bytes(r.digest) for r in listed.collect()}
    assert digests["big.c4m"] == sha(canonical) and digests["big.txt"] == sha(large) and os.path.getsize(tmp_path / "w/edge.txt") == 10_000_000
    assert w.store.missing(listed).count() == 0
    assert w.store.get_one(digests["big.c4m"]) == canonical and w.store.get_one(digests["big.txt"]) == large
    out = tmp_path / "bundle"
    assert tuple(w.store.export(listed, str(out)).first()) == (3, 0, 0)
    t = BlobStore(spark, "file://" + str(tmp_path / "other"))
    assert tuple(t.ingest(str(out)).first()) == (3, 0, 0, []) and t.missing(listed).count() == 0
    (out / id_text(sha(canonical))).write_bytes(large)  # the file as it was, under its ID
    u = BlobStore(spark, "file://" + str(tmp_path / "third"))
    assert tuple(u.ingest(str(out)).first()) == (3, 0, 0, []) and u.get_one(sha(canonical)) == canonical
    s = BlobStore(spark, "file://" + str(tmp_path / "unnamed"))
    s.put(contents(spark, large))
    assert s.has(sha(canonical))
    v = BlobStore(spark, "file://" + str(tmp_path / "streamed"))
    fill_store(spark, str(tmp_path / "w"), v, str(tmp_path / "state")).awaitTermination(120)
    assert v.missing(listed).count() == 0


def test_expected_files(spark):
    e = spark.createDataFrame([("m", "a", bytearray(b"1")), ("m", "b", None), ("m", "c", bytearray(b"1")), ("m", "d", bytearray(b"1")), ("n", "a", None)], "manifest_id string, path string, digest binary")
    a = spark.createDataFrame([("m", "a", bytearray(b"1")), ("m", "b", bytearray(b"2")), ("m", "c", bytearray(b"2")), ("n", "z", None)], "manifest_id string, path string, digest binary")
    got = {(r.manifest_id, r.path): r.status for r in trees.expected_status(e, a).collect()}
    assert got == {("m", "a"): "there", ("m", "b"): "there", ("m", "c"): "corrupt", ("m", "d"): "pending", ("n", "a"): "pending"}


def test_empty_files_reach_the_store(spark, tmp_path):
    build(tmp_path / "t", {"empty": b"", "full": b"x"})
    store = BlobStore(spark, "file://" + str(tmp_path / "store"))
    listed = scan(spark, str(tmp_path / "t"))
    from stemma.sources.scan import scan_and_store

    assert scan_and_store(spark, str(tmp_path / "t"), store, "m").count() == 2 and store.missing(listed).count() == 0
    streamed = BlobStore(spark, "file://" + str(tmp_path / "streamed"))
    fill_store(spark, str(tmp_path / "t"), streamed, str(tmp_path / "state")).awaitTermination(120)
    assert streamed.missing(listed).count() == 0
