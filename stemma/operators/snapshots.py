"""What changed between consecutive full listings of a tree.

A store keeps, for every tree, the ordinals of its keys (paths), which never change once given, and for
every listing a compressed bitmap of its ordinals and column vectors aligned to them. A listing that
arrives is brought to ordinals and compared with its predecessor's bitmap and vectors: AND-NOT gives
additions and removals, the vectors at the common ordinals give changes. Older listings aren't read.

A tree's keys are spread over buckets by hash, as many as its first listings ask for, so buckets are
independent tasks of bounded size however large one tree is; ordinals are dense within a bucket.
"""

from __future__ import annotations

import os
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stemma.functions.bitmaps import OrdinalBitmap
from stemma.functions.modes import whole_seconds
from stemma.runtime import remove_at_exit, shared_folder, written

FIELDS = ("dh", "size", "ts")
#: Rows among which a task combines those of one path before they are sent on.
COMBINE_ROWS = 1_000_000
# One written table holds, by kind: the key of an ordinal; a listing's bitmap and vectors; a change.
_ROW = "kind string, tree string, bucket int, path string, ordinal long, manifest_id string, members binary, dh binary, size binary, ts binary, status string"
_ARROW = pa.schema(
    [("kind", pa.string()), ("tree", pa.string()), ("bucket", pa.int32()), ("path", pa.string()), ("ordinal", pa.int64()), ("manifest_id", pa.string())]
    + [(n, pa.binary()) for n in ("members", *FIELDS)] + [("status", pa.string())]
)


def listings(manifests: DataFrame) -> DataFrame:
    """(manifest_id, tree, pos, n): position of each listing in its tree by seq, and their number.

    Manifests registered more than once count once; those without a tree or seq are left out.
    """
    once = manifests.where("tree is not null and seq is not null").groupBy("manifest_id").agg(F.min("tree").alias("tree"), F.min("seq").alias("seq"))
    w = Window.partitionBy("tree")
    ranked = once.withColumn("pos", F.row_number().over(w.orderBy("seq", "manifest_id")).cast("int") - 1)
    return ranked.select("manifest_id", "tree", "pos", F.count(F.lit(1)).over(w).cast("int").alias("n"))


def _last_rows(path: pa.Array, group: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Of the rows of each (path, group) the one with the greatest order."""
    code = path.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
    key = code * (int(group.max(initial=0)) + 1) + group
    by = np.lexsort((order, key))
    key = key[by]
    return by[np.append(key[1:] != key[:-1], True)] if len(by) else by


def _combined(batches):
    """Rows without those that a later row of their listing replaces, as far as a task has both."""

    def last(held):
        t = pa.Table.from_batches(held).combine_chunks()
        column = lambda n: t[n].combine_chunks()
        tree = column("tree").dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
        pos = t["pos"].to_numpy().astype(np.int64)
        keep = _last_rows(column("path"), tree * (int(pos.max(initial=0)) + 1) + pos, t["ord"].to_numpy())
        return t.take(pa.array(keep)).to_batches(max_chunksize=50_000)  # rows of a path together, which packs well

    held, n = [], 0
    for b in batches:
        if len(b):
            held.append(b)
            n += len(b)
        if n >= COMBINE_ROWS:
            yield from last(held)
            held, n = [], 0
    if held:
        yield from last(held)


def _vector(values: np.ndarray, null: np.ndarray) -> bytes:
    return np.packbits(null).tobytes() + values.astype(np.int64).tobytes()


def _unpacked(raw: bytes, n: int) -> tuple[np.ndarray, np.ndarray]:
    at = -(-n // 8)
    return np.frombuffer(raw, np.int64, n, at), np.unpackbits(np.frombuffer(raw, np.uint8, at), count=n).astype(bool)


class _State:
    """A listing's part in one bucket: its bitmap and, by ordinal, its vectors."""

    def __init__(self, bitmap: OrdinalBitmap, vectors: list[tuple[np.ndarray, np.ndarray]]):
        self.bitmap, self.ordinals, self.vectors = bitmap, bitmap.ordinals(), vectors

    @classmethod
    def of(cls, ordinals: np.ndarray, columns: list[pa.Array]) -> "_State":
        by = np.argsort(ordinals)
        vectors = [(pc.fill_null(c, 0).to_numpy(zero_copy_only=False)[by], pc.is_null(c).to_numpy(zero_copy_only=False)[by]) for c in columns]
        return cls(OrdinalBitmap.of(ordinals), vectors)

    @classmethod
    def loads(cls, row: dict) -> "_State":
        bitmap = OrdinalBitmap.loads(row["members"])
        return cls(bitmap, [_unpacked(row[f], len(bitmap)) for f in FIELDS])

    def dumps(self) -> dict:
        return {"members": self.bitmap.dumps()} | {f: _vector(*v) for f, v in zip(FIELDS, self.vectors)}

    def changes_to(self, new: "_State") -> list[tuple[str, np.ndarray]]:
        common = (self.bitmap & new.bitmap).ordinals()
        a, b = np.searchsorted(self.ordinals, common), np.searchsorted(new.ordinals, common)
        differ = np.zeros(len(common), dtype=bool)
        for (v, v_null), (w, w_null) in zip(self.vectors, new.vectors):
            differ |= (v_null[a] != w_null[b]) | (~v_null[a] & ~w_null[b] & (v[a] != w[b]))
        return [("added", new.bitmap.andnot(self.bitmap).ordinals()), ("removed", self.bitmap.andnot(new.bitmap).ordinals()), ("modified", common[differ])]


_EMPTY = _State(OrdinalBitmap({}), [(np.zeros(0, np.int64), np.zeros(0, bool))] * len(FIELDS))


def _advance(key: tuple, known: pa.Table, new: pa.Table) -> pa.Table:
    """New keys, states and changes of one bucket of a tree. known: its keys and the state of the listing
    before the new ones; new: rows of listings, and for each listing a row without a path."""
    tree, bucket = (k.as_py() for k in key)
    rows = pc.is_valid(new["path"])
    order = new.filter(pc.invert(rows))
    names = dict(zip(order["pos"].to_pylist(), order["manifest_id"].to_pylist()))
    new = new.filter(rows).combine_chunks()
    pos = new["pos"].to_numpy().astype(np.int64)
    keep = _last_rows(new["path"].combine_chunks(), pos, new["ord"].to_numpy())
    new, pos = new.take(pa.array(keep)), pos[keep]

    old_keys = known.filter(pc.equal(known["kind"], "key"))
    by = np.argsort(old_keys["ordinal"].to_numpy())
    paths = pa.concat_arrays([old_keys["path"].take(pa.array(by)).combine_chunks().cast(pa.string()), new["path"].combine_chunks().cast(pa.string())]).dictionary_encode()
    ordinal = paths.indices.to_numpy(zero_copy_only=False).astype(np.int64)[len(by) :]  # known paths come first and keep theirs
    path_of = paths.dictionary

    out = [{"kind": ["key"] * (len(path_of) - len(by)), "path": path_of.slice(len(by)), "ordinal": np.arange(len(by), len(path_of))}]
    state = next((_State.loads(r) for r in known.filter(pc.equal(known["kind"], "state")).to_pylist()), None)
    columns = [new[f].combine_chunks() for f in FIELDS]
    for p in sorted(names):
        at = np.flatnonzero(pos == p)
        now = _State.of(ordinal[at], [c.take(pa.array(at)) for c in columns])
        if p > 0:
            for status, ords in (state or _EMPTY).changes_to(now):
                out.append({"kind": ["change"] * len(ords), "path": path_of.take(pa.array(ords)), "manifest_id": [names[p]] * len(ords), "status": [status] * len(ords)})
        out.append({"kind": ["state"], "manifest_id": [names[p]]} | {k: [v] for k, v in now.dumps().items()})
        state = now
    parts = []
    for o in out:
        n = len(o["kind"])
        o |= {"tree": [tree] * n, "bucket": [bucket] * n}
        parts.append(pa.table([pa.array(o[f.name], f.type) if f.name in o and not isinstance(o[f.name], pa.Array) else o.get(f.name, pa.nulls(n, f.type)) for f in _ARROW], schema=_ARROW))
    return pa.concat_tables(parts)


class SnapshotStore:
    """Keys, states and changes of the listings loaded so far, as parquet in a folder all executors share.

    trees: buckets of each tree, fixed when the tree is first loaded. loads: one folder a load, by kind.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _read(self, name: str, schema: str) -> DataFrame:
        try:
            return self.spark.read.schema(schema).parquet(f"{self.folder}/{name}")
        except Exception as e:
            if "PATH_NOT_FOUND" in str(e):
                return self.spark.createDataFrame([], schema)
            raise

    def rows(self, kind: str, load: int | None = None) -> DataFrame:
        """Rows of one kind: key, state or change; of all loads or of one."""
        d = self._read("loads", _ROW + ", load int").where(F.col("kind") == kind)
        return d if load is None else d.where(F.col("load") == load)

    def listed(self) -> DataFrame:
        """(manifest_id, tree, pos, load) of the listings in the store."""
        return self._read("listed", "manifest_id string, tree string, pos int, load int")

    def add(self, manifests: DataFrame, entries: DataFrame, keys_per_bucket: int = 8_192) -> int | None:
        """Loads the listings that the store doesn't have; returns the number of the load, None if there are none.

        manifests: all listings registered so far, loaded ones included, as their order gives each its place. New
        ones must come after those of their trees that are loaded: a listing between two is an error. Of several
        rows of a path in one listing the one with the greatest ``ord`` counts; paths that are null are left
        out, rows of unregistered manifests too. Of what is stored, the keys of the trees concerned and the
        state of each tree's last listing are read.
        """
        have = self.listed()
        before = have.groupBy("tree").agg(F.max("pos").alias("last"), F.max_by("load", "pos").alias("last_load"), F.max_by("manifest_id", "pos").alias("last_id"))
        fresh = listings(manifests).join(have.select("manifest_id"), "manifest_id", "left_anti").join(before, "tree", "left")
        late = fresh.where("pos <= last").select("manifest_id").limit(5).collect()
        if late:
            raise ValueError(f"listings before the last one of their tree: {', '.join(r.manifest_id for r in late)}")
        n_load = (have.agg(F.max("load")).first()[0] or 0) + 1
        fresh = fresh.select("manifest_id", "tree", "pos", "last_load", "last_id")
        sizes = entries.groupBy("manifest_id").agg(F.count(F.lit(1)).alias("rows"))
        trees = self._read("trees", "tree string, buckets int")
        new_trees = fresh.join(sizes, "manifest_id", "left").groupBy("tree").agg(F.greatest(F.lit(1), F.ceil(F.max("rows") / keys_per_bucket)).cast("int").alias("buckets"))
        new_trees.join(trees.select("tree"), "tree", "left_anti").write.mode("append").parquet(f"{self.folder}/trees")
        # written, so that its size is known where it is joined
        of = written(fresh.join(self._read("trees", "tree string, buckets int"), "tree"), "listings")
        of.select("manifest_id", "tree", "pos", F.lit(n_load).alias("load")).write.mode("append").parquet(f"{self.folder}/listed")
        if self.listed().where(F.col("load") == n_load).isEmpty():
            return None

        rows = entries.where("path is not null").select("manifest_id", "path", "ord", "digest", "size", "ts").join(of.select("manifest_id", "tree", "pos", "buckets"), "manifest_id").select(
            "tree", F.pmod(F.xxhash64("path"), F.col("buckets")).cast("int").alias("bucket"), "path", F.lit(None).cast("string").alias("manifest_id"), "pos", F.coalesce("ord", F.lit(-(2**62))).alias("ord"),
            F.when(F.col("digest").isNotNull(), F.xxhash64("digest")).alias("dh"), "size", whole_seconds(F.col("ts")).alias("ts"),
        )
        schema = "tree string, bucket int, path string, manifest_id string, pos int, ord long, dh long, size long, ts long"
        rows = rows.mapInArrow(_combined, schema)
        # a row a listing and bucket, so that a bucket knows of listings that have no row in it
        marks = of.select("tree", F.explode(F.sequence(F.lit(0), F.col("buckets") - 1)).alias("bucket"), F.lit(None).cast("string").alias("path"), "manifest_id", "pos", *[F.lit(None).cast("long").alias(c) for c in ("ord", *FIELDS)])
        kind = "kind string, tree string, bucket int, path string, ordinal long, members binary, dh binary, size binary, ts binary"
        if n_load == 1:
            known = self.spark.createDataFrame([], kind)
        else:
            names = [f.split()[0] for f in kind.split(", ")]
            keys = self.rows("key").join(of.select("tree").distinct(), "tree", "left_semi").select(*names)
            last = of.where("last_id is not null").select("tree", F.col("last_id").alias("manifest_id"), F.col("last_load").alias("load")).distinct()
            loads = [r.load for r in last.select("load").distinct().limit(1001).collect()]
            states = self.rows("state")
            states = states.where(F.col("load").isin(loads)) if len(loads) <= 1000 else states  # other loads aren't opened
            known = keys.unionByName(states.join(last, ["tree", "manifest_id", "load"], "left_semi").select(*names))
        done = known.groupBy("tree", "bucket").cogroup(rows.unionByName(marks).groupBy("tree", "bucket")).applyInArrow(_advance, _ROW)
        done.write.option("compression", "zstd").partitionBy("kind").parquet(f"{self.folder}/loads/load={n_load}")
        return n_load

    def changes(self, load: int | None = None) -> DataFrame:
        """(manifest_id, path, status) of every listing but the first of its tree; of all loads or of one."""
        return self.rows("change", load).select("manifest_id", "path", "status")


def snapshot_changes(manifests: DataFrame, entries: DataFrame, keys_per_bucket: int = 8_192) -> DataFrame:
    """Rows (manifest_id, path, status) of every listing but the first of its tree.

    Null equals only null; times are compared in whole seconds, digests by a 64-bit hash of all their
    bytes. A registered listing without rows removes every path of the one before. For listings that keep
    arriving keep a SnapshotStore; this loads one and reads its changes.
    """
    folder = os.path.join(shared_folder(entries.sparkSession), "stemma", f"snapshots-{uuid.uuid4().hex}")
    remove_at_exit(entries.sparkSession, folder)
    store = SnapshotStore(entries.sparkSession, folder)
    store.add(manifests, entries, keys_per_bucket)
    return store.changes()
