"""Copy comparison and snapshot changes against plain dictionaries."""

import datetime as dt
import random
import shutil

import pytest

from stemma.operators.copies import compare_mirrors, verify_report
from stemma.operators.snapshots import SnapshotStore, snapshot_changes
from stemma.schema import ENTRY

T0 = dt.datetime(2024, 1, 1)
COLS = ENTRY + ", tree string, difference string, status string"  # columns whose names clash with results


def row(m, path, ord=0, mode=0o644, ts=T0, size=1, digest=b"d" * 64, target=None):
    name = path.rsplit("/", 1)[-1] if path else path
    return (m, 0, ord, path, None, name, 0, False, mode, ts, size, None if digest is None else bytearray(digest), target, 0, "", None, False, None, "clash", "clash", "clash")


def frame(spark, rows):
    return spark.createDataFrame(rows, COLS)


def manifests(spark, rows):
    return spark.createDataFrame(rows, "manifest_id string, tree string, seq int, mirrored boolean, path string")


def norm(r):
    mode = r[8] & 0o7777 if r[8] is not None and r[8] & 0o170000 == 0o100000 else r[8]
    return (mode, None if r[9] is None else r[9].replace(microsecond=0), r[10], None if r[11] is None else bytes(r[11]), r[12])


def last(rows):
    best = {}
    for r in rows:
        if r[3] is not None and ((k := (r[0], r[3])) not in best or (r[2] if r[2] is not None else -1) > (best[k][2] if best[k][2] is not None else -1)):
            best[k] = r
    return {k: norm(r) for k, r in best.items()}


def random_rows(rng, names, n):
    out = []
    for _ in range(n):
        r = row(rng.choice(names), rng.choice("abcdefgh") + rng.choice(["", "/x", " y"]), 0, rng.choice([0o644, 0o100644, 0o755, None]), rng.choice([T0, T0 + dt.timedelta(milliseconds=300), T0 + dt.timedelta(seconds=1), None]),
                rng.choice([1, 2, None]), rng.choice([b"a" * 64, b"b" * 64, None]), rng.choice([None, "t"]))
        out.append(r)
    best, uniq = set(), []
    for i, r in enumerate(out):
        uniq.append(r[:2] + (i,) + r[3:])
        if rng.random() < 0.2:
            uniq.append(uniq[-1])  # exact repeat
    return uniq


@pytest.mark.parametrize("seed,per", [(1, 8), (2, 1), (3, 1000)])
def test_copies(spark, seed, per):
    rng = random.Random(seed)
    a, b = random_rows(rng, ["m1", "m2", "m3"], 60), random_rows(rng, ["m1", "m2", "m4"], 60)
    b += rng.sample(a, 30)
    ms = manifests(spark, [("m1", "t", 1, True, "x"), ("m1", "t", 1, True, "x"), ("m2", "t", 2, True, "x"), ("m3", "t", 3, None, "x"), ("m4", "t", 4, False, "x")])
    b = [r[:2] + (i,) + r[3:] for i, r in enumerate(b)]
    left, right = ({k: v for k, v in last(x).items() if k[0] in ("m1", "m2")} for x in (a, b))
    want = [(*k, "missing") for k in left.keys() - right.keys()] + [(*k, "extra") for k in right.keys() - left.keys()]
    for k in left.keys() & right.keys():
        want += [(*k, f) for f, x, y in zip(("mode", "ts", "size", "digest", "target"), left[k], right[k]) if x != y]
    got = compare_mirrors(ms, frame(spark, a), frame(spark, b), rows_per_bucket=per).collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_copies_edges(spark):
    ms = manifests(spark, [("m", "t", 1, True, "x")])
    one, none = frame(spark, [row("m", "p")] * 5), frame(spark, [])
    assert [tuple(r) for r in compare_mirrors(ms, one, none).collect()] == [("m", "p", "missing")]
    assert [tuple(r) for r in compare_mirrors(ms, none, one).collect()] == [("m", "p", "extra")]
    assert compare_mirrors(ms, none, none).count() == 0 == compare_mirrors(ms, one, one).count()
    assert compare_mirrors(ms.limit(0), one, none).count() == 0
    blank = frame(spark, [row("m", "p", None, None, None, None, None, None)])
    assert {r.difference for r in compare_mirrors(ms, one, blank).collect()} == {"mode", "ts", "size", "digest"}
    assert compare_mirrors(ms, blank, blank).count() == 0
    long = frame(spark, [row("m", "p" * 200_000)])
    assert compare_mirrors(ms, long, none).count() == 1
    assert [tuple(r) for r in verify_report(ms, one, none).collect()] == [("m", 1, 0, 0, 0)]


@pytest.mark.parametrize("seed,per", [(1, 60_000), (2, 3)])
def test_snapshots(spark, seed, per):
    rng = random.Random(seed)
    names = [f"m{i}" for i in range(6)] + ["stray"]
    rows = random_rows(rng, names, 150)
    ms = manifests(spark, [("m0", "t", 1, False, "x"), ("m1", "t", 3, False, "x"), ("m1", "t", 3, False, "x"), ("m2", "t", 9, False, "x"), ("void", "t", 10, False, "x"), ("m3", "u", 1, False, "x"), ("m4", "u", 2, False, "x"), ("m5", "v", 1, False, "x"), ("n", None, 1, False, "x")])
    have = last(rows)
    want = []
    for old, new in (("m0", "m1"), ("m1", "m2"), ("m2", "void"), ("m3", "m4")):
        a, b = ({k[1]: (v[3], v[2], v[1]) for k, v in have.items() if k[0] == m} for m in (old, new))
        want += [(new, p, "added") for p in b.keys() - a.keys()] + [(new, p, "removed") for p in a.keys() - b.keys()] + [(new, p, "modified") for p in a.keys() & b.keys() if a[p] != b[p]]
    got = snapshot_changes(ms, frame(spark, rows), keys_per_bucket=per).collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_snapshots_edges(spark):
    ms = manifests(spark, [("a", "t", 1, False, "x"), ("b", "t", 2, False, "x")])
    rows = frame(spark, [row("a", "p"), row("a", None), row("b", "p", 1), row("b", "p", 1), row("b", "p", 0, size=7), row("b", "q" * 100_000)])
    assert [(r.manifest_id, r.path[:1], r.status) for r in snapshot_changes(ms, rows).collect()] == [("b", "q", "added")]
    assert snapshot_changes(ms, rows.limit(0)).count() == 0 and snapshot_changes(ms.limit(0), rows).count() == 0


def test_snapshots_one_by_one(spark, tmp_path):
    """Each load reads the keys and the state of the listing before only, and ordinals stay."""
    rng = random.Random(3)
    names = [f"m{i}" for i in range(5)]
    rows = random_rows(rng, names, 150)
    registered = [(m, "t" if i < 4 else "u", i, False, "x") for i, m in enumerate(names)]
    want = sorted(tuple(r) for r in snapshot_changes(manifests(spark, registered), frame(spark, rows), keys_per_bucket=20).collect())
    store = SnapshotStore(spark, f"file://{tmp_path}/store")
    got, ordinals = [], {}
    for i in range(5):
        so_far = manifests(spark, registered[: i + 1])
        load = store.add(so_far, frame(spark, rows), keys_per_bucket=20)
        got += [tuple(r) for r in store.changes(load).collect()]
        for r in store.rows("key").collect():
            assert ordinals.setdefault((r.tree, r.bucket, r.path), r.ordinal) == r.ordinal
        assert len(set((t, b, o) for (t, b, _), o in ordinals.items())) == len(ordinals)
        if i >= 1:  # states before the last one and old changes aren't needed any more
            for kind in ("state", "change"):
                shutil.rmtree(tmp_path / "store" / "loads" / f"load={i}" / f"kind={kind}", ignore_errors=True)
        assert store.add(so_far, frame(spark, rows)) is None
    assert sorted(got) == want
    with pytest.raises(ValueError):
        store.add(manifests(spark, [("late", "t", -1, False, "x"), *registered]), frame(spark, rows))


def test_a_hot_path(spark):
    """A row repeated in a third of all rows is combined before it is sent on."""
    ms = manifests(spark, [("a", "t", 1, False, "x"), ("b", "t", 2, False, "x")])
    rows = [row("a", f"p{i}") for i in range(2000)] + [row("a", "hot")] * 1000 + [row("b", "hot", size=3)] * 1000
    got = snapshot_changes(ms, frame(spark, rows)).groupBy("status").count().collect()
    assert {r.status: r["count"] for r in got} == {"removed": 2000, "modified": 1}
