import hashlib
import random

import numpy as np
import pytest

from stemma.llm.golomb import decode_block, encode_block
from stemma.llm.seen import Layout, SeenBefore


@pytest.mark.parametrize("n,span", [(1, 10), (2, 1), (100, 30), (512, 9), (3000, 40), (1, 0)])
def test_blocks_round_trip(n, span):
    rng = np.random.default_rng(n)
    base = 5 << span
    v = np.sort(rng.choice(1 << span, n, replace=False) if span < 20 else np.unique(rng.integers(0, 1 << span, 2 * n))[:n]).astype(np.int64) + base
    notes = rng.integers(0, 1 << 33, len(v)) if n % 2 else np.zeros(len(v), np.int64)
    block = encode_block(v, base, span, notes)
    a, b = decode_block(block, base)
    assert a.tolist() == v.tolist() and b.tolist() == notes.tolist()
    if n == 3000:
        bits = 8 * (len(block["unary"]) + len(block["rest"])) / len(v)
        assert bits < span - np.log2(len(v)) + 3  # near the theoretical log2(range / n) + 1.5


def key(i):
    return None if i is None else bytearray(64) if i == "nil" else bytearray(hashlib.sha512(str(i).encode()).digest())


def plain(earlier, records):
    known, out = {bytes(key(k)) for k in earlier if k not in (None, "nil")}, []
    for r, k in sorted(records, key=lambda x: x[0]):
        if k in (None, "nil"):
            continue
        k = bytes(key(k)) if not isinstance(k, bytearray) else bytes(k)
        if k in known:
            out.append(r)
        known.add(k)
    return out


def frames(spark, earlier, records):
    e = spark.createDataFrame([(key(k), "x") for k in earlier], "key binary, v string")
    r = spark.createDataFrame([(n, k if isinstance(k, bytearray) else key(k), "x") for n, k in records], "record long, key binary, first string")
    return e, r


@pytest.mark.parametrize("bits", [20, 2, 0])
def test_against_a_set(spark, bits):
    """With few bits many values are shared, so that the byte comparison has work to do."""
    rng = random.Random(bits)
    earlier = [rng.randrange(3000) for _ in range(1500)] + [None, "nil"]
    records = [(n, rng.choice([None, "nil", 7, 7, 7]) if rng.random() < 0.3 else rng.randrange(6000)) for n in rng.sample(range(-50, 100_000), 3000)]
    s = SeenBefore(*frames(spark, earlier, records), fp_bits=bits)
    assert sorted(r.record for r in s.seen().collect()) == plain(earlier, records)
    r = s.report().first()
    assert r.seen == len(plain(earlier, records)) and r.blocks > 1
    assert (r.false_positives > 0) == (bits < 20) and r.audited_fp < 3 * max(r.theoretical_fp, 1e-3)


def test_all_bytes_count(spark):
    a = key(1)
    b = bytearray(a[:-1] + bytes([a[-1] ^ 1]))
    s = SeenBefore(*frames(spark, [1], [(1, b), (2, a), (3, b)]))
    assert sorted(r.record for r in s.seen().collect()) == [2, 3]


def test_edges(spark):
    for earlier, records, want in (([], [], []), ([1], [], []), ([], [(5, 1)], []), ([], [(5, 1), (4, 1), (6, 1)], [5, 6]), ([None, "nil"], [(1, None), (2, "nil"), (3, "nil")], []), ([1], [(0, 1)] , [0])):
        s = SeenBefore(*frames(spark, earlier, records))
        assert sorted(r.record for r in s.seen().collect()) == want
        assert s.report().count() == 1


def test_layout():
    assert Layout.for_rows(0, 20).range_bits == 21 and Layout.for_rows(2**43, 20).range_bits == 63
    with pytest.raises(ValueError):  # bits against false positives aren't taken away silently
        Layout.for_rows(10**15, 40)
