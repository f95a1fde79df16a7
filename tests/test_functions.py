"""IDs, field forms, names and orders against golden values and plain Python."""

import datetime as dt
import hashlib
import random

import pytest
from pyspark.sql import functions as F

from stemma.functions import fmt, ident, names
from stemma.functions.base58 import MAX_ID, digests_of, id_text, is_id, parse_id
from stemma.functions.bitmaps import OrdinalBitmap
from stemma.schema import NIL, ancestors, conflict_path, display_path, entry_name, parent_path, path_depth
from stemma.sources.codec import _mode_text, _printable, mode_of, name_field, natural_order

# Published identifiers of short contents and of sets of them.
GOLDEN = {
    b"": "c459dsjfscH38cYeXXYogktxf4Cd9ibshE3BHUo6a58hBXmRQdZrAkZzsWcbWtDg5oQstpDuni4Hirj75GEmTc1sFT",
    b"foo": "c45xZeXwMSpqXjpDumcHMA6mhoAmGHkUo7r9WmN2UgSEQzj9KjgseaQdkEJ11fGb5S1WEENcV3q8RFWwEeVpC7Fjk2",
}
NASTY = ["", "a", "two words", 'q"uote', "br[1]ack", "tab\there", "nl\n", "cr\r", "nul\0x", "back\\slash", "¤cur¤", "zw​j", "mix​\u0001end", "é", "名前", "dir name/", "­/", "a\x7fb", "𝕏 "]


def test_golden_ids(spark):
    rows = spark.createDataFrame([(bytearray(k),) for k in GOLDEN], "c binary").select("c", ident.id_text(ident.digest_of(F.col("c"))).alias("t")).collect()
    assert {bytes(r.c): r.t for r in rows} == GOLDEN


def test_ids_round_trip_and_reject():
    rng = random.Random(1)
    for raw in [NIL, b"\xff" * 64, *[rng.randbytes(64) for _ in range(50)]]:
        assert parse_id(id_text(raw)) == raw and is_id(id_text(raw))
    many = [NIL, b"\xff" * 64, *[rng.randbytes(64) for _ in range(300)]]
    assert digests_of([None, *map(id_text, many), "no", "c4" + "z" * 88]) == [None, *many, None, None]
    for bad in ("", "c4" + "1" * 87, "x4" + "1" * 88, "c4" + "0" * 88, "c4" + "z" * 88, MAX_ID[:-1] + "z"):
        assert not is_id(bad)
        with pytest.raises(ValueError):
            parse_id(bad)


def test_id_columns_handle_null(spark):
    df = spark.createDataFrame([(None,), (bytearray(NIL),), (bytearray(b"short"),)], "d binary")
    got = df.select("d", ident.id_text("d").alias("t")).withColumn("b", ident.try_digest("t")).collect()
    assert [r.t for r in got] == [None, "c4" + "1" * 88, None] and [r.b for r in got] == [None, NIL, None]


@pytest.mark.parametrize("n", [0, 1, 2, 3, 5, 100])
def test_set_identity(spark, n):
    digests = [hashlib.sha512(str(i).encode()).digest() for i in range(n)]
    df = spark.createDataFrame([(bytearray(d),) for d in digests + digests[:2]] + [(None,)], "digest binary")
    got = ident.set_identity(df).collect()
    level = sorted(set(digests))
    while len(level) > 1:  # plain restatement
        level = [hashlib.sha512(b"".join(sorted(level[i : i + 2]))).digest() if len(level[i : i + 2]) == 2 else level[i] for i in range(0, len(level), 2)]
    assert [bytes(r.tree_digest) for r in got] == level
    assert ident.tree_digest(digests) == (level[0] if level else NIL)


def test_modes(spark):
    modes = [None, 0, 0o644, 0o100644, 0o40755, 0o120777, 0o104755, 0o102644, 0o41777, 0o41666, 0o10600, 0o140600, 0o60660, 0o20620, *range(0, 0o7777, 97)]
    rows = spark.createDataFrame([(m,) for m in modes], "m int").select("m", fmt.format_mode(F.col("m")).alias("t")).withColumn("b", fmt.parse_mode(F.col("t"))).collect()
    for r in rows:
        want = _mode_text(r.m) if r.m else "-" * 10
        assert r.t == want
        assert r.b == mode_of(want) == ((r.m & 0o7777 if r.m & 0o170000 == 0o100000 else r.m) or None if r.m else None) or r.m & 0o170000 == 0o100000 and not r.m & 0o7777
    bad = spark.createDataFrame([("rwx",), ("-rw-r--r-q",), ("",), (None,)], "t string").select(fmt.parse_mode(F.col("t")).alias("b")).collect()
    assert all(r.b is None for r in bad)


def test_names(spark):
    got = spark.createDataFrame([(n,) for n in NASTY], "n string").select("n", fmt.safe_name(F.col("n")).alias("s"), fmt.format_name(F.col("n"), F.lit(False)).alias("f")).withColumn("u", names.unsafe_name("s")).collect()
    for r in got:
        assert r.s == _printable(r.n), r
        assert r.u == r.n
        assert r.f == name_field(r.n, False)


def test_bytes_that_are_no_text():
    assert names.raw_bytes("a¤⣿¤b") == b"a\xffb" and names.raw_name("a¤⣿¤b") == "a¤⣿¤b"
    assert names.raw_name("lone\\ and ¤ alone \\q") == "lone\\ and ¤ alone \\q"


def test_sequences(spark):
    got = spark.createDataFrame([("fr [0001-0100].exr",), ("a[x][1,3-5]b[1]",), ("plain",)], "n string").select("n", fmt.format_name(F.col("n"), F.lit(True)).alias("f"), fmt.is_sequence(F.col("n")).alias("q"), fmt.is_sequence(F.lit("a\\[1\\]")).alias("e")).collect()
    assert [r.f for r in got] == ["fr\\ [0001-0100].exr", "a\\[x\\][1,3-5]b\\[1\\]", "plain"]
    assert [r.q for r in got] == [True, True, False] and not got[0].e


def test_sizes_and_times(spark):
    r = spark.createDataFrame([(0, None), (1023, dt.datetime(1970, 1, 1)), (1024, dt.datetime(2025, 9, 1, 0, 36, 18)), (5 * 10**9, None), (None, None)], "s long, t timestamp")
    got = r.select(fmt.human_size(F.col("s")).alias("h"), fmt.comma_size(F.col("s")).alias("c"), fmt.format_ts(F.col("t")).alias("t")).collect()
    assert [x.h for x in got] == ["0 B", "1023 B", "1.0 KB", "4.7 GB", None]
    assert [x.c for x in got] == ["0", "1,023", "1,024", "5,000,000,000", "-"]
    assert [x.t for x in got] == ["-", "-", "2025-09-01T00:36:18Z", "-", "-"]
    p = spark.createDataFrame([("2025-09-01T02:36:18+02:00",), ("2025-09-01T00:36:18Z",), ("Sep  1 00:36:18 2025 UTC",), ("-",), ("x",)], "t string").select(fmt.parse_ts(F.col("t")).alias("p")).collect()
    assert [x.p for x in p] == [dt.datetime(2025, 9, 1, 0, 36, 18)] * 3 + [None, None] or [str(x.p)[:19] for x in p[:3]] == ["2025-09-01 00:36:18"] * 3


def test_natural_order(spark):
    ns = ["file10.txt", "file2.txt", "file1.txt", "render.01.exr", "render.1.exr", "render.001.exr", "render.10.exr", "b", "a", "a1/", "a/", "a-b/", "10", "9", "x00", "x0", "x"]
    got = [r.n for r in spark.createDataFrame([(n,) for n in ns], "n string").orderBy(fmt.natural_key(F.col("n"))).collect()]
    assert got == sorted(ns, key=natural_order)
    paths = ["src/", "README.md", "src/main.go", "a/", "a/z.txt", "a/b/", "a/b/c.txt", "file10", "file2"]
    got = [r.n for r in spark.createDataFrame([(n,) for n in paths], "n string").orderBy(fmt.tree_key(F.col("n"))).collect()]
    assert got == ["README.md", "file2", "file10", "a/", "a/z.txt", "a/b/", "a/b/c.txt", "src/", "src/main.go"]


def test_paths(spark):
    p = F.col("p")
    got = spark.createDataFrame([("a/b/c.txt",), ("a/",), ("x",), ("a/b/",)], "p string").select(
        display_path(p), path_depth(p), entry_name(p), parent_path(p), conflict_path(p), ancestors(p)
    ).collect()
    assert [tuple(r) for r in got] == [
        ("a/b/c.txt", 2, "c.txt", "a/b/", "a/b/c.txt.conflict", ["a/", "a/b/"]),
        ("a", 0, "a/", None, "a.conflict/", []),
        ("x", 0, "x", None, "x.conflict", []),
        ("a/b", 1, "b/", "a/", "a/b.conflict/", ["a/"]),
    ]


def test_bitmaps():
    rng = random.Random(3)
    for size in (0, 10, 5000, 60000):
        a, b = ({rng.randrange(200_000) for _ in range(size)} for _ in range(2))
        x, y = OrdinalBitmap.of(list(a)), OrdinalBitmap.of(list(b))
        assert x.andnot(y).ordinals().tolist() == sorted(a - b)
        assert (x & y).ordinals().tolist() == sorted(a & b)
        assert len(x) == len(a)


# Published identifiers of short contents and of sets of them.
GOLDEN_IDS = {
    "": "c459dsjfscH38cYeXXYogktxf4Cd9ibshE3BHUo6a58hBXmRQdZrAkZzsWcbWtDg5oQstpDuni4Hirj75GEmTc1sFT",
    "foo": "c45xZeXwMSpqXjpDumcHMA6mhoAmGHkUo7r9WmN2UgSEQzj9KjgseaQdkEJ11fGb5S1WEENcV3q8RFWwEeVpC7Fjk2",
    "bar": "c45KgBYEvEE7Yfv16JAgnUT29bon2WsYAiBFZvnKNJiQR8kya2tRtEdfD6vi8bjvmmDDrepEGmkNvk88M8NWdeV9ig",
}
GOLDEN_SETS = {
    "foo,bar": "c458j3otjXhCWJGZxbxvbf2BuFaRknZkCBQwUWJAQRZFKxuU9zpUpVQxPqYwGHuK56e7aJZSYE1fNsHZ8WtNDfq3hK",
    "foo,bar,baz": "c42To6i5r7uwfJUt7p2JY9XKTUYqyCCGQCip3ujctUXzwYMMiSZmRKwm657ninwK41uZ5RRVCUjgHXcNzD3TAGqUey",
}


def test_identity_queries_over_tables(spark, tmp_path):
    import hashlib

    from stemma.functions.base58 import id_text
    from stemma.plans.manifests import QUERIES

    assert not {"identify_golden", "tree_id_golden"} & QUERIES.keys()  # they read no table
    sha = lambda b: hashlib.sha512(b).digest()
    texts = [*GOLDEN_IDS, None, "é\n", "x" * 5000]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r.id for r in QUERIES["identify_contents"](spark, str(tmp_path)).collect()}
    assert got == {i: id_text(sha((t or "").encode())) for i, t in enumerate(texts)}
    assert {t: got[i] for i, t in enumerate(texts[:3])} == GOLDEN_IDS
    # members in any order, repeated, null
    rows = [(m, sha(x.encode())) for m in GOLDEN_SETS for x in [*reversed(m.split(",")), "foo"]] + [("foo,bar", None)]
    spark.createDataFrame([(m, d and bytearray(d)) for m, d in rows], "manifest_id string, digest binary").write.parquet(str(tmp_path / "entries.parquet"))
    sets = {r.manifest_id: id_text(bytes.fromhex(r.tree_digest)) for r in QUERIES["manifest_set_identity"](spark, str(tmp_path)).collect()}
    assert sets == GOLDEN_SETS


def test_bitmaps_are_stored():
    import numpy as np

    from stemma.functions.bitmaps import OrdinalBitmap

    rng = np.random.default_rng(5)
    for n in (0, 1, 4096, 4097, 70_000):
        a = OrdinalBitmap.of(rng.choice(300_000, n, replace=False))
        b = OrdinalBitmap.of(rng.choice(300_000, 5000, replace=False))
        again = OrdinalBitmap.loads(a.dumps())
        assert again.ordinals().tolist() == a.ordinals().tolist() and len(again) == n
        assert (again & b).ordinals().tolist() == (a & b).ordinals().tolist() and b.andnot(again).ordinals().tolist() == b.andnot(a).ordinals().tolist()


def test_ids_of_many_digests():
    import hashlib

    from stemma.functions.base58 import digests_of, id_text, texts_of_ids

    digests = [hashlib.sha512(bytes([i])).digest() for i in range(100)] + [bytes(64), b"\xff" * 64]
    assert texts_of_ids([None, b"short", *digests]) == [None, None, *map(id_text, digests)]
    assert digests_of([id_text(d) for d in digests]) == digests
