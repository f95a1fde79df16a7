"""Line loading against field-by-field diagnosis, and cases of each reason."""

import datetime as dt
import random

import pyarrow as pa
import pytest

from stemma.functions.base58 import MAX_ID, id_text
from stemma.operators.lines import diagnose, load_lines, parsed, rejected, strict_columns, suspects

ID = id_text(bytes(range(64)))
GOOD = f"-rw-r--r-- 2024-02-29T23:59:59Z 1,234 a\\ b.txt {ID}"
CASES = [
    (None, None), ("", None), ("    ", None), (ID, None), (ID + ID, None), ("  " + ID, None), (ID + " " + ID, ["columns"]),
    (GOOD, []), ("      " + GOOD, []), (GOOD + "\r", ["c4id"]), ("- - - x -", []), ("---------- 0 0 d/ -", []),
    (GOOD.replace("1,234", "1,23"), ["size"]), (GOOD.replace("1,234", "9223372036854775807"), []), (GOOD.replace("1,234", "9223372036854775808"), ["size"]),
    (GOOD.replace("1,234", "000,001"), []), (GOOD.replace("1,234", "٣"), ["size"]), (GOOD.replace("1,234", ""), ["size"]),
    (GOOD.replace("02-29", "02-30"), ["ts"]), (GOOD.replace("2024-02", "2023-02"), ["ts"]), (GOOD.replace("23:59:59Z", "24:00:00Z"), ["ts"]), (GOOD.replace("59Z", "59+23:59"), []), (GOOD.replace("59Z", "59+24:00"), ["ts"]), (GOOD.replace("59Z", "59"), ["ts"]),
    (GOOD.replace("-rw-", "?rw-"), ["mode"]), (GOOD.replace("-rw-r--r--", "0644"), ["mode"]), (GOOD.replace("-rw-r--r--", "--"), ["mode"]), (GOOD.replace("-rw-r--r--", "TTTTTTTTTT"), ["mode"]), (GOOD.replace("-rw-r--r--", "-TTTTTTTTT"), []),
    (GOOD.replace("a\\ b.txt", 'a"b'), ["quoting"]), (GOOD.replace("a\\ b.txt", "a\\xb"), ["quoting"]), (GOOD.replace("a\\ b.txt", "a\\\\"), []), (GOOD.replace("a\\ b.txt", ""), ["quoting"]), (GOOD.replace("a\\ b.txt", "a b"), ["columns"]),
    (f"lrwxrwxrwx - - l -> t\\ u {ID}", []), (f"lrwxrwxrwx - - l ->  {ID}", ["quoting"]), (f"lrwxrwxrwx - - l => t {ID}", ["columns"]), (f"lrwxrwxrwx - - l -> t", ["columns"]),
    ("- - - x c4" + "z" * 88, ["c4id"]), ("- - - x " + MAX_ID, []), ("- - - x " + ID[:-1], ["c4id"]), ("- - - x\\", ["columns"]), ("- - - x -\\", ["c4id"]),
    ('x y z q"\\ w', ["columns"]), ('x y z q"\\ w v', ["quoting", "mode", "ts", "size", "c4id"]), ("a  b", ["columns"]),
]


@pytest.mark.parametrize("line,want", CASES)
def test_reasons(line, want):
    got = diagnose(line)
    assert (got if got is None else sorted(got)) == (want if want is None else sorted(want))


def test_blocks_agree_with_single_lines():
    rng = random.Random(7)
    pool = [c for c, _ in CASES] + [GOOD] * 60 + ["two\nlines", GOOD + "\n" + GOOD]
    for n in (0, 1, 31, 64, 65, 500):
        lines = [rng.choice(pool) for _ in range(n)]
        cells, read = parsed(pa.array(lines, pa.string()))
        assert suspects(read) == [i for i in range(n) if not read[i]] == suspects(read, block=n or 1)
        for i, line in enumerate(lines):
            if read[i]:  # only valid lines are read, and as the strict path reads them
                assert diagnose(line) == []
                want = strict_columns(line)
                assert {k: v[i].cast(pa.int64()).as_py() if k == "ts" else v[i].as_py() for k, v in cells.items()} == want
    assert parsed(pa.array([GOOD] * 3))[1].all()


def test_days():
    """The column parse and the strict pattern take the same days."""
    days = [f"{y:04}-{m:02}-{d:02}T00:00:00Z" for y in (0, 1, 1900, 1999, 2000, 2024, 9999) for m in range(14) for d in range(33)]
    read = parsed(pa.array([f"- {day} - x -" for day in days]))[1]
    assert [bool(x) for x in read] == [diagnose(f"- {day} - x -") == [] for day in days]


def test_columns(spark):
    rows = [
        (1, GOOD, "extra"), (2, f"drwxr-sr-t 2024-01-01T00:30:00+05:30 - d\\[1\\]/ -", None), (3, f"lrwxrwxrwx 0 5 l\\n -> \\\"t {ID}", None), (4, None, None), (5, "bad", None), (6, GOOD, None),
        (7, "- - 9223372036854775807 " + "n" * 300_000 + " -", None),
    ]
    df = spark.createDataFrame(rows, "line_id long, line string, reasons string")
    got = {r.line_id: r for r in load_lines(df).collect()}
    a, b, c = got[1], got[2], got[3]
    assert (a.valid, a.mode, a.size, a.name, a.target, a.c4id) == (True, 0o644, 1234, "a b.txt", None, ID)
    assert a.ts.replace(tzinfo=None) == dt.datetime(2024, 2, 29, 23, 59, 59)
    assert (b.mode, b.size, b.name, b.c4id) == (0o43755, None, "d[1]/", None) and b.ts.replace(tzinfo=None) == dt.datetime(2023, 12, 31, 19, 0)
    assert (c.mode, c.ts, c.name, c.target) == (0o120777, None, "l\n", '"t')
    assert got[4].valid is None and got[5].valid is False and got[5].reasons == ["columns"] and got[6].valid
    assert got[7].size == 2**63 - 1 and len(got[7].name) == 300_000
    assert {(r.line_id, r.reason) for r in rejected(df).collect()} == {(5, "columns")}
    assert rejected(df.limit(0)).count() == 0 and load_lines(df.limit(0)).count() == 0
