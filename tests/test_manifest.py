"""Manifest operators: filters, aggregates, order, rollups, versions, validation."""

import datetime as dt
import fnmatch
import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from stemma.functions import ident
from stemma.functions.base58 import parse_id
from stemma.operators import manifest as M
from stemma.operators import rollup, validate, versions
from stemma.sources import codec
from stemma.sources.codec import canonical_text_line, decode, entries_of, natural_order

T0 = "2025-06-15T12:00:00Z"
FOO = "c45xZeXwMSpqXjpDumcHMA6mhoAmGHkUo7r9WmN2UgSEQzj9KjgseaQdkEJ11fGb5S1WEENcV3q8RFWwEeVpC7Fjk2"
BAR = "c45KgBYEvEE7Yfv16JAgnUT29bon2WsYAiBFZvnKNJiQR8kya2tRtEdfD6vi8bjvmmDDrepEGmkNvk88M8NWdeV9ig"


def load(spark, *texts):
    return decode(spark.createDataFrame([(f"m{i}", t) for i, t in enumerate(texts)], "manifest_id string, text string"))


def cid(content):
    from stemma.functions.base58 import id_text

    return id_text(hashlib.sha512(content.encode()).digest())


def f(name, content="x", ts=T0, indent=0):
    return " " * indent + f"-rw-r--r-- {ts} {len(content)} {name} {cid(content)}\n"


SAMPLE = f("README.md", "r" * 100) + f"drwxr-xr-x - - src/ -\n" + f("main.go", "m" * 2000, indent=2) + f("util.go", "dup", indent=2) + "drwxr-xr-x - - assets/ -\n" + f("logo.exr", "dup", indent=2)


def test_navigation(spark):
    e = load(spark, SAMPLE)
    assert [r.display_path for r in M.flat_entries(e).orderBy("ord").collect()] == ["README.md", "src", "src/main.go", "src/util.go", "assets", "assets/logo.exr"]
    assert M.files(e).count() == 4 and M.directories(e).count() == 2
    assert M.by_path(e, "src/").first().ord == 1 and M.contains(e, "src/main.go") and not M.contains(e, "nope")
    assert M.at_index(e, 2).first().name == "main.go"
    assert [r.path for r in M.sort_entries(e).collect()] == ["README.md", "assets/", "assets/logo.exr", "src/", "src/main.go", "src/util.go"]
    assert [r.path for r in M.ranked(e).orderBy("rank").collect()] == [r.path for r in M.sort_entries(e).collect()]
    assert M.subtree(e, "src").count() == 3
    s = M.summary(e).first()
    assert (s.entries, s.files, s.directories, s.total_size, s.unique_ids, s.human_total) == (6, 4, 2, 2106, 3, "2.1 KB")
    d = M.duplicates(e).collect()
    assert [(r.copies, r.first_path, r.wasted) for r in d] == [(2, "src/util.go", 3)]
    assert sorted(r.path for r in M.duplicate_paths(e).collect()) == ["assets/logo.exr", "src/util.go"]
    assert M.summary(e.limit(0)).count() == 0 and M.duplicates(e.limit(0)).count() == 0


@pytest.mark.parametrize("glob", ["*", "*.go", "src/*", "?rc", "[a-r]*", "[!a-r]*", "*[.]go", "a[]b]c", "[^x]*", "x[", "a.b", "[!]]*", "*é*", "[\\]*"])
def test_globs(glob):
    for name in ["a.go", "src", "src/a.go", "rc", "xrc", "zz", "a]c", "abc", "x[", "a.b", "aXb", "]q", "^x", "café", "a\nb.go", "\\"]:
        assert bool(re.search(M.glob_pattern(glob).replace("(?s)^", "(?s)\\A").removesuffix("$") + "\\Z", name)) == fnmatch.fnmatchcase(name, glob), (glob, name)


def test_globs_on_columns(spark):
    e = load(spark, SAMPLE)
    assert {r.path for r in M.filter_entries(e, "*.go", "README*").collect()} == {"README.md", "src/main.go", "src/util.go"}
    assert M.filter_entries(e, lambda d: d.size > 1000).count() == 1 == M.filter_entries(e, F.col("size") > 1000).count()


def test_golden_manifest(spark):
    e = load(spark, f"-rw-r--r-- {T0} 3 README.md {FOO}\ndrwxr-xr-x - - src/ -\n  -rw-r--r-- {T0} 3 main.go {BAR}\n")
    assert {r.path: r.size for r in rollup.roll_up(e).collect()}["src/"] == 136
    golden = load(spark, f"-rw-r--r-- {T0} 3 README.md {FOO}\n-rwxr-xr-x {T0} 136 src/ -\n  -rw-r--r-- {T0} 3 main.go {BAR}\n")
    got = rollup.manifest_ids(golden).select(ident.id_text("digest").alias("t")).first().t
    assert got == "c41wTSeGA3GcrWobYqfmHPsw3dN6onn6e5ggoSio8WBzPGf56qWHWQLU1uW1vRPHu5xfc8JNeZNF3u9dz6yqajnaVE"


def test_golden_directory(spark):
    ts, logo = "2026-03-26T19:54:06Z", "c44u5PeLq5Vtb4E2KQYBHhX3rZwi295ZJJ4Q9cfV81SLry847KWf8ptjMcbp9HdUDk7HXhUdFx2FuN74yj7kFEasJD"
    e = load(spark, f"drwxr-xr-x - - assets/ -\n  -rw-r--r-- {ts} 15 logo.png {logo}\n")
    got = rollup.scan_metadata(e).where("path = 'assets/'").select("size", F.date_format("ts", "HH:mm:ss").alias("t"), ident.id_text("digest").alias("id")).first()
    assert tuple(got) == (150, "19:54:06", "c45Mv4sZFMYy4cbbWbvJCMfyMnUd64JmMZXfE7T73KsEcW2pSeVwQgP7fHqHD6dPx6ohhWo34qfNrXGwFGAERzqdYp")


def plain_rollup(rows):
    """Sizes, times and IDs of directories by recursion."""
    rows = {r["path"]: dict(r) for r in rows}
    kids = lambda p: [r for r in rows.values() if (r["parent"] or "") == p]

    def fill(p):
        for r in kids(p):
            if r["is_dir"]:
                fill(r["path"])
                c = kids(r["path"])
                if r["size"] is None:
                    r["size"] = None if any(x["size"] is None for x in c) else sum(x["size"] + len(canonical_text_line(x).encode()) + 1 for x in c)
                if r["ts"] is None:
                    r["ts"] = max(x["ts"] for x in c) if c and all(x["ts"] for x in c) else None

    def name(p):
        for r in kids(p):
            if r["is_dir"]:
                name(r["path"])
                c = sorted(kids(r["path"]), key=lambda x: (x["is_dir"], natural_order(x["name"])))
                r["digest"] = hashlib.sha512("".join(canonical_text_line(x) + "\n" for x in c).encode()).digest()

    fill("")
    sizes = {p: (r["size"], r["ts"]) for p, r in rows.items()}
    name("")
    return sizes, {p: r["digest"] for p, r in rows.items()}


@pytest.mark.parametrize("rows_per_task", [rollup.ROWS_PER_TASK, 5])
def test_rollup_against_recursion(spark, rows_per_task):
    """Manifests taken whole by a task, and larger ones in rounds, give the same."""
    from tests.test_codec import random_text

    rng = random.Random(11)
    many = [random_text(rng) for _ in range(12)] + [SAMPLE, "drwxr-xr-x - - only/ -\n"]
    e = load(spark, *many).cache()
    filled = rollup.roll_up(e, rows_per_task=rows_per_task)
    ids = rollup.directory_ids(filled, rows_per_task=rows_per_task)
    sizes_got = {(r.manifest_id, r.path): (r.size, r.ts and r.ts.replace(tzinfo=dt.timezone.utc)) for r in filled.collect()}
    ids_got = {(r.manifest_id, r.path): r.digest and bytes(r.digest) for r in ids.collect()}
    for i, text in enumerate(many):
        rows = [r for k, r in entries_of(text) if k == "entry"]
        sizes, digests = plain_rollup(rows)
        for p, want in sizes.items():
            assert sizes_got[f"m{i}", p] == want, (p, text)
            assert ids_got[f"m{i}", p] == digests[p], (p, text)


def paths(d):
    return sorted(r.path for r in d.collect())


def one(spark, text):
    return load(spark, text)


def test_diff(spark):
    old = one(spark, f("same") + f("gone", "g") + f("changed", "1") + "- - - noid -\n")
    new = one(spark, f("same").replace("-rw-", "-rw-", 1) + f("changed", "2") + f("new", "n") + "- - 5 noid -\n")
    got = {r.path: r.status for r in versions.diff(old, new).collect()}
    assert got == {"same": "same", "gone": "removed", "changed": "modified", "new": "added", "noid": "modified"}
    assert tuple(versions.diff_counts(versions.diff(old, new)).first()) == ("m0", 1, 1, 2, 1)
    regular = new.withColumn("mode", F.col("mode").bitwiseOR(F.lit(0o100000)))
    assert {r.status for r in versions.diff(new, regular).collect()} == {"same"}  # the regular-file bit doesn't count


def test_renames(spark):
    old = one(spark, f("a1", "A") + f("a2", "A") + f("b", "B"))
    new = one(spark, f("c1", "A") + f("c2", "A") + f("d", "D"))
    ch = versions.diff(old, new)
    assert [tuple(r)[1:] for r in versions.renames(ch).collect()] == [("a2", "c1")]
    assert sorted(tuple(r)[1:] for r in versions.renames(ch, consume=False).collect()) == [("a2", "c1"), ("a2", "c2")]


def test_patches(spark):
    old = one(spark, f("file1", "hello") + f("file2", "world") + "drwxr-xr-x - - d/ -\n" + f("in", "i", indent=2) + "  drwxr-xr-x - - e/ -\n" + f("deep", "z", indent=4))
    new = one(spark, f("file1", "goodbye") + f("file3", "3"))
    p = versions.patch(old, new)
    assert paths(p) == ["d/", "d/e/", "d/e/deep", "d/in", "file1", "file2", "file3"]
    assert paths(versions.apply_patch(old, p)) == ["file1", "file3"]
    only_dir = p.where("path = 'd/'")
    assert paths(versions.apply_patch(old, only_dir)) == ["file1", "file2"]  # what is below goes too
    assert versions.patch(old, old).count() == 0
    assert paths(versions.apply_patch(old, p.limit(0))) == paths(old)


def test_patch_keeps_what_lies_below_a_lost_directory_row(spark):
    old, new = one(spark, "drwxr-xr-x - - d/ -\n" + f("x", indent=2) + f("y", indent=2)), one(spark, "drwxr-xr-x - - d/ -\n" + f("x", indent=2)).where("path <> 'd/'")
    assert paths(versions.patch(old, new)) == ["d/y"]
    assert paths(versions.apply_patch(old, versions.patch(old, new))) == ["d/", "d/x"]


@pytest.mark.parametrize("seed", [1, 2])
def test_patch_round_trip(spark, seed):
    from tests.test_codec import random_text

    rng = random.Random(seed)
    old, new = (load(spark, *[random_text(rng) for _ in range(6)]) for _ in range(2))
    got = versions.apply_patch(old, versions.patch(old, new))
    cols = ["manifest_id", "path", "mode", "ts", "size", "digest", "hard_link", "flow_target"]
    # a directory that goes takes all below with it, as nothing below can stay in the new version
    assert sorted(map(str, got.select(cols).collect())) == sorted(map(str, new.select(cols).collect()))


def test_chain(spark):
    text = f("file1", "hello") + f("file2", "world") + cid("x") + "\n" + f("file1", "goodbye") + f("file2", "world") + cid("y") + "\n" + f("file3", "3")
    e = one(spark, text)
    final = versions.resolve_chain(e)
    assert {r.path: r.size for r in final.collect()} == {"file1": 7, "file3": 1}
    assert paths(versions.resolve_chain(e, upto=1)) == ["file1"]
    log = versions.log_chain(e).orderBy("index").collect()
    states = [versions.resolve_chain(e, upto=k) for k in range(3)]
    assert [bytes(r.digest) for r in log] == [bytes(rollup.manifest_ids(s.withColumns({"depth": F.lit(0), "parent": F.lit(None).cast("string")})).first().digest) for s in states]
    assert [tuple(r)[1:7] for r in log] == [(1, 2, 0, 0, True, 2), (2, 0, 1, 1, False, 1), (3, 1, 0, 0, False, 2)]


@pytest.mark.parametrize("seed", [3, 4])
def test_patch_texts(spark, seed):
    from tests.test_codec import random_text

    rng = random.Random(seed)
    for old_text, new_text in ((random_text(rng), random_text(rng)), (SAMPLE, SAMPLE.replace("main.go", "main2.go") + f("top"))):
        old, new = one(spark, old_text), one(spark, new_text)
        text = versions.patch_text(old, new)
        base = "".join(r.line + "\n" for r in codec.entry_lines(old).orderBy("key").collect())
        chain = one(spark, base + text)
        assert text.splitlines()[0] == rollup.manifest_ids(old).select(ident.id_text("digest").alias("t")).first().t
        cols = ["path", "mode", "ts", "size", "digest", "hard_link"]
        assert sorted(map(str, versions.resolve_chain(chain).select(cols).collect())) == sorted(map(str, new.select(cols).collect()))


LATE = "2025-07-01T00:00:00Z"
MERGES = [
    (f("a"), f("a") + f("b", "2"), f("a") + f("c", "3"), ["a", "b", "c"], []),
    (f("a", "0"), f("a", "1"), f("a", "2", LATE), ["a", "a.conflict"], ["a"]),
    (f("a", "0"), f("a", "1"), f("a", "0"), ["a"], []),
    (f("a", "0"), f("a", "1"), f("a", "1", LATE), ["a"], []),
    (f("a", "0"), f("a", "1"), "", ["a"], ["a"]),
    (f("a", "0"), "", f("a", "1"), ["a"], ["a"]),
    (f("a", "0"), f("a", "0"), "", [], []),
    (f("a", "0"), "", f("a", "0"), [], []),
    (f("a", "0"), "", "", [], []),
    ("", f("a", "1"), f("a", "2"), ["a", "a.conflict"], ["a"]),
    ("", f("a", "1"), f("a", "1"), ["a"], []),
    ("- - 1 a -\n", "- - 2 a -\n", "- - 3 a -\n", ["a"], []),  # no IDs on any side: equal
]


@pytest.mark.parametrize("b,l,r,want,conflicts", MERGES)
def test_merge(spark, b, l, r, want, conflicts):
    rows, c = versions.merge(one(spark, b), one(spark, l), one(spark, r))
    assert paths(rows) == want and paths(c) == conflicts


def test_merge_winner(spark):
    rows, _ = versions.merge(one(spark, f("a", "0")), one(spark, f("a", "local")), one(spark, f("a", "remote", LATE)))
    assert {r.path: r.size for r in rows.collect()} == {"a": 6, "a.conflict": 5}
    rows, _ = versions.merge(None, one(spark, f("a", "local")), one(spark, f("a", "remote")))
    assert {r.path: r.size for r in rows.collect()} == {"a": 5, "a.conflict": 6}  # a tie goes to local
    rows, _ = versions.merge(None, one(spark, "- - - d/ -\n" + f("x", indent=2)).where("not is_dir"), one(spark, f("y")))
    assert paths(rows) == ["d/", "d/x", "y"]


def test_validate(spark):
    bad = spark.createDataFrame(
        [("m", o, p, n, d, m, s, g, "clash") for o, p, n, d, m, s, g in [
            (0, "a", "a", 0, 0o644, 1, None), (1, "a", "a", 0, None, None, None), (2, "x/", "x/", 1, 0o100644, 1, None), (3, "y", "y", 3, 0o40755, 1, None), (4, "..", "..", 3, 0, -2, bytearray(3)), (5, "", "", 0, 0o170000, 1, None),
            (6, "p/q", "p/q", 0, 0, 1, None), (7, "b\\", "b\\", 0, 0, 1, None), (8, "n\0", "n\0", 0, 0, 1, None), (9, "/", "/", 0, 0, 1, None), (10, None, None, 0, None, None, None),
        ]], "manifest_id string, ord long, path string, name string, depth int, mode int, size long, digest binary, message string",
    )
    got = sorted((r.line, r.code) for r in validate.validate(bad).collect())
    assert (2, "path_duplicate") in got and (4, "depth_jump") in got and (3, "slash_not_directory") in got and (3, "depth_jump") not in got
    assert {c for n, c in got if n == 5} == {"name_dots", "size_negative", "digest_length"} and {c for n, c in got if n == 6} == {"name_empty", "mode_type"}
    assert {c for n, c in got if n >= 7} == {"name_separator", "name_backslash", "name_nul", "name_slash", "name_empty"}
    s = spark.createDataFrame([("-rw-r--r--",), ("-",), ("zrw-r--r-q",), ("x",)], "t string").select(validate.mode_string_messages(F.col("t")).alias("m")).collect()
    assert [len(r.m) for r in s] == [0, 0, 2, 1]
    s = spark.createDataFrame([(FOO,), ("-",), ("c4" + "z" * 88,), ("x",), ("c4" + "0" * 88,)], "t string").select(validate.id_string_messages(F.col("t")).alias("m")).collect()
    assert [len(r.m) for r in s] == [0, 0, 1, 2, 1]


def test_combining(spark):
    e = one(spark, SAMPLE)
    assert paths(M.under_prefix(e, "p/q").select("path"))[:3] == ["p/", "p/q/", "p/q/README.md"]
    u = M.union_manifests({"a": e, "b": e}, "all")
    assert u.count() == 14 and u.select("manifest_id").distinct().count() == 1
    assert parse_id(FOO)


@pytest.mark.parametrize("bits", [16, 1])
def test_paths_across_blocks(spark, bits):
    """Directories are carried from block to block."""
    rows = [("m", i, n, d) for i, (n, d) in enumerate([("a/", 0), ("b/", 1), ("x", 2), ("y", 2), ("c/", 1), ("z", 2), ("q/", 0), ("w", 1), ("top", 0)])] + [("n", 0, "only", 0)]
    got = {(r.manifest_id, r.path): r.parent for r in M.with_paths(spark.createDataFrame(rows, "manifest_id string, ord long, name string, depth int"), bits).collect()}
    assert got == {("m", "a/"): None, ("m", "a/b/"): "a/", ("m", "a/b/x"): "a/b/", ("m", "a/b/y"): "a/b/", ("m", "a/c/"): "a/", ("m", "a/c/z"): "a/c/", ("m", "q/"): None, ("m", "q/w"): "q/", ("m", "top"): None, ("n", "only"): None}
