"""Directory sizes, times and IDs from the bottom up.

Files are aggregated by parent once, for all depths together. The directories of a manifest of up to
ROWS_PER_TASK rows are then finished in one task, deepest first; those of a larger one go round by
round, each round a step over all its directories of one depth, written to the shared folder.
"""

from __future__ import annotations

import functools
import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stemma.functions.base58 import id_text as text_of_id
from stemma.functions.fmt import format_size, format_ts, line_without_id, natural_key
from stemma.functions.ident import digest_of, hex_text, id_text, streamed_hash
from stemma.functions.modes import whole_seconds
from stemma.runtime import written
from stemma.schema import known_digest, latest

#: Rows of a manifest up to which one task takes it whole.
ROWS_PER_TASK = 1_000_000
_SUMS = {"_n": "long", "_sizes": "long", "_times": "long", "_size": "long", "_bytes": "long", "_ts": "timestamp"}


def _line_bytes(digest: Column) -> Column:
    """Bytes of a canonical line with its line feed; an ID has 90, a missing one is a dash."""
    return F.octet_length(line_without_id()) + 1 + F.when(known_digest(digest), 90).otherwise(1) + 1


def _split(entries: DataFrame, name: str, rows_per_task: int) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """One row a path, with _dir, written; and those of them in manifests up to rows_per_task rows and in
    larger ones (None if there are none)."""
    rows = latest(entries.where(F.col("depth").isNotNull()))
    rows = written(rows.withColumn("_dir", F.col("path").endswith("/")), name, ("_dir",))
    large = rows.groupBy("manifest_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > rows_per_task).select(F.col("manifest_id").alias("_large"))
    if large.isEmpty():
        return rows, rows, None
    large = written(large, "large")
    same = F.col("manifest_id").eqNullSafe(F.col("_large"))
    return rows, rows.join(large, same, "left_anti"), rows.join(large, same, "left_semi")


def _levels(rows: DataFrame) -> int:
    return rows.agg(F.max("depth")).first()[0] or 0


def _sums(children: DataFrame) -> DataFrame:
    """What a directory needs of its children, by the directory's path."""
    return children.where("parent is not null").groupBy("manifest_id", F.col("parent").alias("path")).agg(
        F.count(F.lit(1)).alias("_n"), F.count("size").alias("_sizes"), F.count("ts").alias("_times"), F.sum("size").alias("_size"), F.sum(_line_bytes(F.col("digest"))).alias("_bytes"), F.max("ts").alias("_ts")
    )


def roll_up(entries: DataFrame, empty_size_zero: bool = True, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """Rows (one a path) with null sizes and times of directories filled from their children.

    size: the children's sizes and the bytes of their lines; time: the latest of the children's. One
    null child makes the result null. An empty directory has size 0 (or null with
    empty_size_zero=False) and no time. Directories keep what they have. Child directories whose IDs
    aren't known yet count with a dash for the ID, as sizes are filled before IDs.
    """
    rows, small, large = _split(entries, "rollup", rows_per_task)
    out = rows.where("not _dir").unionByName(_rolled_whole(small, empty_size_zero))
    if large is not None:
        for level in _rolled_in_rounds(large, empty_size_zero):
            out = out.unionByName(level)
    return out.drop("_dir")


def _with_file_sums(rows: DataFrame) -> DataFrame:
    return rows.where("_dir").join(_sums(rows.where("not _dir")), ["manifest_id", "path"], "left")


def _rolled_whole(rows: DataFrame, empty_size_zero: bool) -> DataFrame:
    # bytes of a line without those of its time and size, of which an absent one takes a byte
    base = _line_bytes(F.col("digest")) - F.octet_length(format_ts(F.col("ts"))) - F.octet_length(format_size(F.col("size"))) + 2
    dirs = _with_file_sums(rows).withColumn("_base", base.cast("long"))
    keep = rows.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)

    def run(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        column = lambda n: t[n].combine_chunks()
        number = lambda n: pc.fill_null(column(n).cast(pa.int64()), 0).to_numpy(zero_copy_only=False).copy()
        valid = lambda n: column(n).is_valid().to_numpy(zero_copy_only=False).copy()
        above = pc.index_in(column("parent"), value_set=column("path"))
        parent = pc.fill_null(above, -1).to_numpy(zero_copy_only=False)
        depth = t["depth"].to_numpy()
        size, has_size, ts, has_ts = number("size"), valid("size"), number("ts"), valid("ts")
        n, sizes, times, total, lines, base_bytes = (number(c) for c in ("_n", "_sizes", "_times", "_size", "_bytes", "_base"))
        latest_ts = np.where(valid("_ts"), number("_ts"), np.iinfo(np.int64).min)
        for d in np.unique(depth)[::-1]:
            at = np.flatnonzero(depth == d)
            none = n[at] == 0
            filled = ~has_size[at] & ((none & empty_size_zero) | (~none & (sizes[at] == n[at])))
            f = at[filled]
            size[f], has_size[f] = np.where(n[f] == 0, 0, total[f] + lines[f]), True
            f = at[~has_ts[at] & ~none & (times[at] == n[at])]
            ts[f], has_ts[f] = latest_ts[f], True
            at = at[parent[at] >= 0]
            p = parent[at]
            digits = np.char.str_len(size[at].astype(str)) if len(at) else np.zeros(0, np.int64)
            shown = has_ts[at] & (ts[at] // 1_000_000 != 0)
            own = base_bytes[at] + np.where(has_size[at] & (size[at] >= 0), digits - 1, 0) + np.where(shown, 19, 0)
            for sums, value in ((n, 1), (sizes, has_size[at]), (times, has_ts[at]), (total, np.where(has_size[at], size[at], 0)), (lines, own)):
                np.add.at(sums, p, value)
            np.maximum.at(latest_ts, p[has_ts[at]], ts[at][has_ts[at]])
        t = t.set_column(t.schema.get_field_index("size"), "size", pa.array(size, mask=~has_size))
        t = t.set_column(t.schema.get_field_index("ts"), "ts", pa.array(ts, mask=~has_ts).cast(t.schema.field("ts").type))
        return t.select(keep)

    return dirs.groupBy("manifest_id").applyInArrow(run, schema)


def _rolled_in_rounds(rows: DataFrame, empty_size_zero: bool) -> list[DataFrame]:
    dirs = written(_with_file_sums(rows).withColumn("_depth", F.col("depth")), "rollup", ("_depth",))
    done, below = [], None
    for depth in range(_levels(dirs), -1, -1):
        here = dirs.where(F.col("_depth") == depth).drop("_depth")
        if below is None:
            here = here.withColumns({f"{c}_d": F.lit(None).cast(t) for c, t in _SUMS.items()})
        else:
            here = here.join(_sums(below).withColumnsRenamed({c: f"{c}_d" for c in _SUMS}), ["manifest_id", "path"], "left")
        both = {c: F.coalesce(F.col(c), F.lit(0)) + F.coalesce(F.col(f"{c}_d"), F.lit(0)) for c in _SUMS if c != "_ts"}
        size = F.when(both["_n"] == 0, F.lit(0) if empty_size_zero else F.lit(None).cast("long")).when(both["_sizes"] == both["_n"], both["_size"] + both["_bytes"])
        ts = F.when(both["_times"] == both["_n"], F.greatest("_ts", "_ts_d"))
        here = here.withColumns({"size": F.coalesce("size", size), "ts": F.coalesce("ts", ts)})
        below = written(here.drop(*_SUMS, *[f"{c}_d" for c in _SUMS]), "rollup")
        done.append(below)
    return done


def _text(digest: str, bits: int) -> Column:
    """An ID's text; digests of another width, which are no IDs, are hexadecimal."""
    return F.when(known_digest(F.col(digest)), id_text(digest) if bits == 512 else hex_text(F.col(digest)))


def _lines(rows: DataFrame, bits: int) -> DataFrame:
    """Lines without their ID, and the ID's text beside it; places in order."""
    return rows.select("manifest_id", "depth", "parent", "path", "_dir", natural_key(F.col("name")).alias("_key"), line_without_id().alias("_line"), _text("digest", bits).alias("_id"))


def _full_line() -> Column:
    return F.concat("_line", F.lit(" "), F.coalesce("_id", F.lit("-")))


def directory_ids(entries: DataFrame, bits: int = 512, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """Rows with every directory's digest: the hash of its children's canonical lines, files first, in
    natural order; that of nothing for an empty directory. Sizes and times as they are (see roll_up).
    bits: width of the hash; that of an ID unless another one is to be compared with.
    """
    rows, small, large = _split(entries, "dirids", rows_per_task)
    own = _hashed_whole(small, bits)
    if large is not None:
        own = own.unionByName(_hashed_in_rounds(large, bits))
    dirs = rows.where("_dir").drop("digest").join(own, ["manifest_id", "path"], "left")
    dirs = dirs.withColumn("digest", F.coalesce("_own", digest_of(F.lit(""), bits))).drop("_own")
    return rows.where("not _dir").unionByName(dirs).drop("_dir")


def _hashed_whole(rows: DataFrame, bits: int) -> DataFrame:
    """(manifest_id, path, _own): hashes of the directories that have children. The children come deepest
    first and stream through the task that has their manifest; a directory's own hash waits, until its line
    is read, for the level above."""
    kind = dict(rows.dtypes)["manifest_id"]

    def run(batches):
        current, directory, h, held = None, None, None, []
        waiting: dict[str, str] = {}
        out: tuple[list, list, list] = ([], [], [])

        def flush():
            h.update("".join(held).encode())
            held.clear()

        def close():
            flush()
            digest = h.digest()
            for o, x in zip(out, (current, directory, digest)):
                o.append(x)
            waiting[directory] = text_of_id(digest) if bits == 512 else digest.hex()

        def emitted():
            b = pa.RecordBatch.from_arrays([pa.array(out[0]).cast(pa.string()), pa.array(out[1], pa.string()), pa.array(out[2], pa.binary())], ["manifest_id", "path", "_own"])
            for o in out:
                o.clear()
            return b

        empty = hashlib.new(f"sha{bits}", b"").digest()
        nothing = text_of_id(empty) if bits == 512 else empty.hex()
        for b in batches:
            for manifest, parent, path, is_dir, line, known in zip(*(c.to_pylist() for c in b.columns)):
                if h is None or parent != directory or manifest != current:
                    if h is not None:
                        close()
                    if manifest != current:
                        waiting.clear()
                    current, directory, h = manifest, parent, hashlib.new(f"sha{bits}")
                held.append(f"{line} {waiting.pop(path, nothing) if is_dir else known or '-'}\n")
                if len(held) == 10_000:
                    flush()
            if len(out[0]) >= 1000:
                yield emitted()
        if h is not None:
            close()
        if out[0]:
            yield emitted()

    lines = _lines(rows.where("parent is not null"), bits).repartition("manifest_id")
    lines = lines.sortWithinPartitions("manifest_id", F.desc("depth"), "parent", "_dir", "_key")
    return lines.select("manifest_id", "parent", "path", "_dir", "_line", "_id").mapInArrow(run, f"manifest_id {kind}, path string, _own binary")


def _hashed_in_rounds(rows: DataFrame, bits: int) -> DataFrame:
    lines = _lines(rows.where("parent is not null"), bits)
    deepest = _levels(rows)
    levels = written(lines.withColumn("_depth", F.col("depth")), "lines", ("_depth",))
    out: list[DataFrame] = []
    for depth in range(deepest, 0, -1):
        children = levels.where(F.col("_depth") == depth).drop("_depth")
        if out:
            below = children.where("_dir").join(out[-1], ["manifest_id", "path"], "left")
        else:
            below = children.where("_dir").withColumn("_own", F.lit(None).cast("binary"))
        below = below.withColumn("_own", F.coalesce("_own", digest_of(F.lit(""), bits))).withColumn("_id", _text("_own", bits)).drop("_own")
        children = children.where("not _dir").unionByName(below)
        hashed = streamed_hash(children.withColumn("_full", _full_line()), ["manifest_id", "parent"], ["_dir", "_key"], "_full", bits)
        out.append(written(hashed.select("manifest_id", F.col("parent").alias("path"), F.col("digest").alias("_own")), "dirids"))
    none = rows.select("manifest_id", "path", F.lit(None).cast("binary").alias("_own")).where(F.lit(False))
    return functools.reduce(DataFrame.unionByName, out, none)


def manifest_ids(entries: DataFrame, bits: int = 512) -> DataFrame:
    """(manifest_id, digest): hash of the canonical lines of each manifest's top rows, after roll_up."""
    filled = roll_up(entries, empty_size_zero=False)
    top = filled.groupBy("manifest_id").agg(F.min("depth").alias("_top"))
    rows = filled.join(top, "manifest_id").where(F.col("depth") == F.col("_top")).withColumn("_dir", F.col("path").endswith("/"))
    return streamed_hash(_lines(rows, bits).withColumn("_full", _full_line()), ["manifest_id"], ["_dir", "_key"], "_full", bits)


def scan_metadata(entries: DataFrame) -> DataFrame:
    """Rows as a scan gives them: whole seconds, sizes and times rolled up, then directory IDs."""
    whole = entries.withColumn("ts", F.timestamp_seconds(whole_seconds(F.col("ts"))))
    return directory_ids(roll_up(whole))
