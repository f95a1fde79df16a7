import itertools
import random

import pytest

from stemma.llm.lookalikes import folded, folding, lookalike_letters, lookalike_pairs, name_classes

COLS = "manifest_id string, parent string, path string, name string, canonical string, form string"


def frame(spark, rows):
    return spark.createDataFrame([(m, p, None if n is None else (p or "") + n, n, "clash", "clash") for m, p, n in rows], COLS)


@pytest.fixture(scope="module")
def table(spark):
    return folding(lookalike_letters(spark))


@pytest.mark.parametrize("a,b", [("ⅽⅼⅭ", "clC"), ("Ꭺꮯ", "Ac"), ("Ⲟ", "O"), ("ꓐ", "B"), ("ɡɑѡ", "gaw"), ("𝐦ⅿ", "mm"), ("ІӀі", "IIi"), ("ａｂｃ１．ｔｘｔ", "abc1.txt"), ("ﬁle", "file"), ("ﬃx", "ffix"), ("e\u0301", "\u00e9"), ("e\u0323\u0302", "\u1ec7"), ("e\u0302\u0323", "\u1ec7"), ("a​b‍c﻿­᠎", "abc"), ("a b c　d", "a b c d"), ("са​р", "cap"), ("Κο", "Ko"), ("K", "K"), ("\u212b", "A\u030a"), ("\u212a", "K"), ("e‍́", "é"), ("ＡЁ", "AË")])
def test_look_the_same(a, b, table):
    assert folded(a, table) == folded(b, table)


@pytest.mark.parametrize("a,b", [("a", "A"), ("e", "é"), ("a b", "a  b"), ("1", "l"), ("O", "0"), ("ё", "е"), ("Đ", "D"), ("я", "r"), ("x²", "x2"), ("¼", "1/4"), ("a", "а́"), ("Ａ", "a"), ("½", "12"), ("ı", "i"), ("ι", "i"), ("Ь", "b"), ("б", "6"), ("ł", "l"), ("…", "..."), ("①", "1")])
def test_look_different(a, b, table):
    assert folded(a, table) != folded(b, table)


def test_against_brute_force(spark, table):
    rng = random.Random(4)
    letters = ["a", "а", "ａ", "b", "\u00e9", "e\u0301", "A", "А", " ", "\xa0", "​", "ﬁ", "fi", "o", "ο", "\t", "\x01", "\x02", "$", "ﬀ"]
    rows = [(rng.choice("mn"), rng.choice([None, "d/", "ԁ/"]), "".join(rng.choice(letters) for _ in range(rng.randrange(1, 4)))) for _ in range(600)]
    rows += rows[:50]
    groups = {}
    for m, p, n in set(rows):
        groups.setdefault((m, p, folded(n, table)), set()).add((p or "") + n)
    want = {(m, *sorted(pair)) for (m, _, _), paths in groups.items() for pair in itertools.combinations(paths, 2)}
    got = [tuple(r) for r in lookalike_pairs(frame(spark, rows)).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_canonical_member(spark):
    rows = [("m", None, n) for n in ("cаp", "cap", "ｃａｐ")] + [("m", "x/", "\u00e9"), ("m", "x/", "e\u0301")]
    got = {(r.path[: r.path.rfind("/") + 1], r.canonical) for r in name_classes(frame(spark, rows)).collect()}
    assert got == {("", "cap"), ("x/", "e\u0301")}


def test_edges(spark):
    long = "a" * 100_000
    rows = [("m", None, None), ("m", None, ""), ("m", None, long), ("m", None, long[:-1] + "а"), (None, None, "а"), (None, None, "a"), ("m", "d/", "x"), ("m", "d/", "x")]
    got = lookalike_pairs(frame(spark, rows)).collect()
    assert [(r.manifest_id, len(r.path_lo)) for r in got] == [("m", 100_000)]
    assert lookalike_pairs(frame(spark, rows).limit(0)).count() == 0
    odd = spark.createDataFrame([("m", "d/", "p1", "x", "", ""), ("m", "d/", "p2", "x", "", "")], COLS)  # paths that aren't parent and name
    assert [tuple(r) for r in lookalike_pairs(odd).collect()] == [("m", "p1", "p2")]
