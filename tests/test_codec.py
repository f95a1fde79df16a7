"""Text format: parsing cases, round trips, canonical forms."""

import datetime as dt
import random
import re

import pytest
from pyspark.sql import functions as F

from stemma.functions.base58 import id_text
from stemma.operators.manifest import with_paths
from stemma.sources import codec
from stemma.sources.codec import BadManifest, canonicalized, decode, dumps, entries_of, entry_of

ID = id_text(bytes(range(64)))
TS = "2025-09-01T00:36:18Z"


def texts(spark, *rows):
    return spark.createDataFrame(rows, "manifest_id string, text string")


LINES = [
    (f"-rw-r--r-- {TS} 1,024 alpha.txt {ID}", {"name": "alpha.txt", "mode": 0o644, "size": 1024, "digest": bytes(range(64))}),
    ("- - - x -", {"mode": None, "ts": None, "size": None, "digest": None}),
    (f"---------- 0 0 d/ -", {"mode": None, "size": 0, "name": "d/", "is_dir": True}),
    (f"lrwxrwxrwx {TS} 5 link -> some/dir/target\\ x {ID}", {"target": "some/dir/target x", "name": "link"}),
    (f"-rw-r--r-- {TS} 5 hard -> {ID}", {"hard_link": -1, "target": None}),
    (f"-rw-r--r-- {TS} 5 hard ->12 {ID}", {"hard_link": 12}),
    (f"-rw-r--r-- {TS} 5 f -> nas:in/path {ID}", {"flow_direction": "->", "flow_target": "nas:in/path"}),
    (f"-rw-r--r-- {TS} 5 f <- nas:in/ {ID}", {"flow_direction": "<-", "flow_target": "nas:in/"}),
    (f"drwxr-xr-x {TS} 5 d/ <> nas: -", {"flow_direction": "<>", "flow_target": "nas:", "name": "d/"}),
    (f"-rw-r--r-- {TS} 5 f -> elsewhere {ID}", {"target": "elsewhere", "hard_link": 0}),
    (f"-rw-r--r-- {TS} 5 loose name with blanks.txt {ID}", {"name": "loose name with blanks.txt"}),
    (f"-rw-r--r-- {TS} 5 frame.[0001-0100].exr {ID}", {"is_sequence": True, "pattern": "frame.[0001-0100].exr"}),
    (f"-rw-r--r-- {TS} 5 frame.\\[1\\].exr {ID}", {"is_sequence": False, "name": "frame.[1].exr"}),
    (f"-rw-r--r-- {TS} 5 tab\\there\\\\ {ID}", {"name": "tab\there\\"}),
    ("-rw-r--r-- 2025-09-01T02:36:18+02:00 5 x -", {"ts": dt.datetime(2025, 9, 1, 0, 36, 18, tzinfo=dt.timezone.utc)}),
    ("-rw-r--r-- Sep  1 00:36:18 2025 UTC    5 x          -", {"ts": dt.datetime(2025, 9, 1, 0, 36, 18, tzinfo=dt.timezone.utc), "name": "x"}),
    ("-rwsr-Sr-t - 1 x -", {"mode": 0o7745}),
    (f"-rw-r--r-- {TS} 5 x trailing", {"name": "x trailing", "digest": None}),
]


@pytest.mark.parametrize("line,want", LINES)
def test_lines(line, want):
    got = entry_of(line)
    assert {k: got[k] for k in want} == want


@pytest.mark.parametrize("bad", ["short", f"-rw-r--r-- {TS} x name -", f"?rw-r--r-- {TS} 5 x -", "-rw-r--r-- 2025-13-01T00:00:00Z 5 x -", f"-rw-r--r-- {TS} 5 x c4bad", "@directive", f"- - - x -\r", f"{ID}\n- - - x -\n{ID}", f"- - - x -\n{ID}\n{ID}\n- - - y -", "﻿- - - x -", f"-rw-r--r-- {TS} 5"])
def test_bad_texts(spark, bad):
    with pytest.raises(BadManifest):
        list(entries_of(bad))
    both = texts(spark, ("bad", bad), ("good", "- - - x -\n"), ("null", None))
    assert [r.manifest_id for r in decode(both, errors="skip").collect()] == ["good"]
    assert [r.manifest_id for r in codec.decode_errors(both).collect()] == ["bad"]


CHAIN = f"""- - 1 a.txt -

drwxr-xr-x {TS} - src/ -
    - - 2 main.go {ID}
    drwxr-xr-x - - lib/ -
        - - 3 x.c -
- - 4 z.txt -
{ID}{ID}
{ID}
- - 9 a.txt -
{ID}
- - 4 z.txt -
"""


def test_paths_and_sections(spark):
    rows = decode(texts(spark, ("m", CHAIN))).orderBy("ord").collect()
    assert [(r.section_idx, r.path, r.parent, r.depth) for r in rows] == [
        (0, "a.txt", None, 0), (0, "src/", None, 0), (0, "src/main.go", "src/", 1), (0, "src/lib/", "src/", 1), (0, "src/lib/x.c", "src/lib/", 2), (0, "z.txt", None, 0), (1, "a.txt", None, 0), (2, "z.txt", None, 0),
    ]
    lists = codec.inline_lists(texts(spark, ("m", CHAIN))).collect()
    assert [(r.pos, bytes(r.digest)) for r in lists] == [(0, bytes(range(64))), (1, bytes(range(64)))]
    assert list(entries_of(ID + "\n- - - x -"))[0][0] == "base"
    again = with_paths(decode(texts(spark, ("m", CHAIN))).where("section_idx = 0").drop("path", "parent")).orderBy("ord").collect()
    assert [(r.path, r.parent) for r in again] == [(r.path, r.parent) for r in rows if r.section_idx == 0]


def random_text(rng):
    lines, open_dirs = [], [0]
    for i in range(rng.randrange(1, 30)):
        depth = rng.randrange(0, len(open_dirs))
        del open_dirs[depth + 1 :]
        directory = rng.random() < 0.3
        name = f"n{i}" + rng.choice(["", "\\ b", "\\[1\\]", "\\\\", "\\t", "é", '\\"', "¤⠁¤"]) + ("/" if directory else "")
        mode = rng.choice(["-", "-rw-r--r--", "-rwsr-x--T"]) if not directory else "drwxr-xr-x"
        link = rng.choice(["", "", " -> nas:p", " <- nas:p", " ->3", " ->"]) if not directory else ""
        lines.append("  " * depth + f"{mode} {rng.choice(['-', TS])} {rng.choice(['-', '0', '123456'])} {name}{link} {rng.choice(['-', ID])}")
        if directory:
            open_dirs.append(0)
    return "\n".join(lines) + "\n"


def test_round_trip(spark, tmp_path):
    rng = random.Random(5)
    many = {f"m{i}": random_text(rng) for i in range(20)}
    many["seq"] = f"- - 1 a\\ [1-5].exr -\nlrwxrwxrwx - 1 l -> t\\ \\\\x {ID}\n"
    rows = decode(texts(spark, *many.items())).cache()
    written = {r.manifest_id: r for r in codec.write_texts(rows, str(tmp_path)).collect()}
    assert written.keys() == many.keys()
    back = decode(codec.read_texts(spark, str(tmp_path)))
    cols = [c for c in rows.columns if c != "ord"]
    assert sorted(map(str, rows.select(cols).collect())) == sorted(map(str, back.select(cols).collect()))
    for name, text in many.items():
        canonical = canonicalized(text.encode())
        assert (tmp_path / f"{name}.c4m").read_bytes() == canonical  # columns and plain Python agree
        assert canonicalized(canonical) == canonical
    assert dumps(rows.where("manifest_id = 'seq'")) == canonicalized(many["seq"].encode()).decode()
    pretty = dumps(rows.where("manifest_id = 'seq'"), pretty=True)
    assert all(len(line.rsplit(" ", 1)[0].rstrip()) < 80 for line in pretty.splitlines())
    p = decode(texts(spark, ("seq", pretty))).select(cols).collect()
    assert sorted(map(str, p)) == sorted(map(str, rows.where("manifest_id = 'seq'").select(cols).collect()))


def test_pretty_layout(spark):
    text = f"-rw-r--r-- {TS} 1234567 a.txt {ID}\n- - - b/ -\n"
    lines = dumps(decode(texts(spark, ("m", text))), pretty=True).splitlines()
    assert lines[0] == "-rw-r--r-- Sep  1 00:36:18 2025 UTC 1,234,567 a.txt".ljust(80) + ID
    assert lines[1] == ("----------" + " " + "-".ljust(25) + " " + "-".rjust(9) + " b/").ljust(80) + "-"


def test_content_that_is_no_manifest():
    for content in (b"", b"\n\n", b"hello", b"- not a manifest", b"-\xff\xff", b"d" * 200):
        assert canonicalized(content) is None
    assert canonicalized(b"  - - 1 b -\n- - 2 a -\n") == b"- - 2 a -\n- - 1 b -\n"


def test_empty(spark):
    assert decode(texts(spark, ("m", ""), ("n", None))).count() == 0
    assert decode(texts(spark, ("m", "x")).limit(0)).count() == 0
    assert codec.entry_lines(decode(texts(spark, ("m", "")))).count() == 0


def test_round_trip_of_whole_manifests(spark, tmp_path, monkeypatch):
    from stemma.plans.manifests import QUERIES

    text = f"drwxr-xr-x {TS} - d/ -\n  drwx------ {TS} - e\\ \\[1\\]/ -\n    -rwsr-x--T {TS} 5 x10 {ID}\n    lrwxrwxrwx {TS} 1 x9 -> t\\ t -\n  prw-r--r-- - 0 p -\n- - - z -\n"
    rows = decode(texts(spark, ("m", text), ("n", "- - - z -\n"))).where("path <> 'd/'")  # d/ is implied only
    rows = rows.unionByName(rows.where("path = 'z'").withColumn("ord", F.lit(-1).cast("long")).withColumn("mode", F.lit(0o100600)))
    rows.orderBy(F.desc("path")).write.parquet(str(tmp_path / "entries.parquet"))
    want = {("m", "d/e [1]/", "d/", 1, 0o40700), ("m", "d/e [1]/x10", "d/e [1]/", 2, 0o5750), ("m", "d/e [1]/x9", "d/e [1]/", 2, 0o120777), ("m", "d/p", "d/", 1, 0o10644), ("m", "z", None, 0, None), ("n", "z", None, 0, None)}
    assert sorted(map(str, QUERIES["manifest_roundtrip"](spark, str(tmp_path)).select("manifest_id", "path", "parent", "depth", "mode").collect())) == sorted(f"Row(manifest_id={m!r}, path={p!r}, parent={q!r}, depth={d}, mode={o})" for m, p, q, d, o in want)
    paths = lambda: {(r.manifest_id, r.path) for r in QUERIES["encode_roundtrip"](spark, str(tmp_path)).collect()}
    assert paths() == {w[:2] for w in want}
    monkeypatch.setattr(codec, "indent", lambda: F.lit(""))
    assert paths() != {w[:2] for w in want}  # a writer that loses the indentation shows


def test_usual_lines_are_read_like_others(monkeypatch):
    """The short way to read a line gives what the grammar gives."""
    rng = random.Random(6)
    modes, times, sizes = ["-", "-rw-r--r--", "drwxr-xr-x", "lrwxrwxrwx", "-rwsr-x--T", "-" * 10, "-rwq------"], ["-", "0", TS, "2024-13-01T00:00:00Z", "1970-01-01T00:00:00Z", "2024-01-01T00:00:00+01:00"], ["-", "0", "12", "1,234", "007"]
    names, ids = ["a", "d/", "-", "->", "c4", "a-b.c", "x/y", "é", "0", "->5", "<-", "a:b", "a b", "a\\ b", "[1-2]", "c4" + "1" * 88], ["-", ID, ID[:-1], "c4" + "z" * 88, "x"]
    lines = [" ".join(map(rng.choice, (modes, times, sizes, names, ids))) for _ in range(4000)]

    def read(line):
        try:
            return codec.entry_of(line)
        except ValueError:
            return None

    short = [read(x) for x in lines]
    monkeypatch.setattr(codec, "_USUAL_LINE", re.compile("(?!)"))
    assert short == [read(x) for x in lines] and sum(x is not None for x in short) > 500
