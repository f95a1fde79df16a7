"""Navigation, filters, aggregates and order of manifests.

All functions take entry rows of any number of manifests and keep them apart by ``manifest_id``.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stemma.functions.fmt import human_size, tree_key
from stemma.functions.modes import S_IFDIR, S_IFLNK, S_IFMT
from stemma.runtime import written
from stemma.schema import ancestors, display_path, entry_name, known_digest, latest, parent_path, path_depth

# --- navigation


def flat_entries(entries: DataFrame) -> DataFrame:
    """Rows with their path as displayed, without a directory's slash."""
    return entries.withColumn("display_path", display_path(F.col("path")))


def with_paths(rows: DataFrame, block_bits: int = 16) -> DataFrame:
    """Rows of (manifest_id, ord, name, depth) with path and parent rebuilt from depth and order.

    A row's parent is the last directory one level up before it, so for each level the last directory is
    carried along, within blocks of 2**block_bits rows by ord and from block to block. A manifest of any
    length spreads over tasks; what is carried is one row a block.
    """
    levels = range(rows.agg(F.max("depth")).first()[0] or 0)
    keys = ["manifest_id", "_block"]
    out = rows.withColumn("_block", F.shiftright("ord", block_bits))
    open_at = lambda d: F.when(F.col("name").endswith("/") & (F.col("depth") == d), F.col("name"))
    ends = out.groupBy(*keys).agg(F.lit(1).alias("_one"), *[F.max_by(open_at(d), F.when(open_at(d).isNotNull(), F.col("ord"))).alias(f"_e{d}") for d in levels]).drop("_one")
    before = Window.partitionBy("manifest_id").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select(*keys, *[F.last(f"_e{d}", ignorenulls=True).over(before).alias(f"_e{d}") for d in levels])
    inner = Window.partitionBy(*keys).orderBy("ord").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = out.select("*", *[F.last(open_at(d), ignorenulls=True).over(inner).alias(f"_d{d}") for d in levels]).join(ends, keys)
    above = F.concat_ws("", *[F.when(F.col("depth") > d, F.coalesce(f"_d{d}", f"_e{d}")) for d in levels]) if len(levels) else F.lit("")
    out = out.withColumn("parent", F.nullif(above, F.lit(""))).withColumn("path", F.concat(above, "name"))
    return out.drop("_block", *[f"_{x}{d}" for d in levels for x in "de"])


def files(entries: DataFrame) -> DataFrame:
    return entries.where(~is_dir())


def directories(entries: DataFrame) -> DataFrame:
    return entries.where(is_dir())


def at_index(entries: DataFrame, index: int) -> DataFrame:
    """The rows at an index of their manifest (by ord)."""
    return entries.where(F.col("ord") == index)


def by_path(entries: DataFrame, path: str) -> DataFrame:
    """The first row of each manifest whose displayed path is ``path``."""
    first = entries.where(display_path(F.col("path")) == path.rstrip("/"))
    return first.groupBy("manifest_id").agg(F.min_by(F.struct(*[c for c in first.columns if c != "manifest_id"]), "ord").alias("_r")).select("manifest_id", "_r.*")


def contains(entries: DataFrame, path: str) -> bool:
    return not entries.where(display_path(F.col("path")) == path.rstrip("/")).isEmpty()


# --- predicates


def is_dir() -> Column:
    """A slash at the end of the name, or a directory's mode."""
    return F.coalesce(F.col("name").endswith("/"), F.lit(False)) | F.coalesce(F.col("mode").bitwiseAND(F.lit(S_IFMT)) == S_IFDIR, F.lit(False))


def is_symlink() -> Column:
    return F.coalesce(F.col("mode").bitwiseAND(F.lit(S_IFMT)) == S_IFLNK, F.lit(False))


def is_flow_linked() -> Column:
    return F.coalesce(F.col("flow_direction"), F.lit("")) != ""


def has_null_fields() -> Column:
    """Any of mode, time, size or digest is null."""
    return F.col("mode").isNull() | F.col("ts").isNull() | F.col("size").isNull() | F.col("digest").isNull()


def is_hidden() -> Column:
    """Some component of the path starts with a dot."""
    return F.col("path").rlike(r"(^|/)\.")


def glob_pattern(glob: str) -> str:
    """Regular expression of a shell pattern in which ``*`` also crosses slashes."""
    out, i = "(?s)^", 0
    while i < len(glob):
        ch = glob[i]
        i += 1
        if ch == "*":
            out += ".*"
        elif ch == "?":
            out += "."
        elif ch == "[" and (end := glob.find("]", i + (glob[i : i + 1] == "!") + 1)) > 0:
            inner = glob[i:end].replace("\\", "\\\\").replace("[", "\\[").replace("&&", "&\\&")
            out += "[" + ("^" + inner[1:] if inner[0] == "!" else "\\" + inner if inner[0] == "^" else inner) + "]"
            i = end + 1
        else:
            out += re.escape(ch)
    return out + "(?!.)"  # the end of the text, also of one that ends in a line feed


def matches(glob: str) -> Column:
    return display_path(F.col("path")).rlike(glob_pattern(glob))


def filter_entries(entries: DataFrame, *tests: str | Column | Callable[[DataFrame], Column]) -> DataFrame:
    """Rows that pass any of the tests: globs, columns or functions of the frame. Paths stay whole."""
    found = F.lit(False)
    for t in tests:
        found = found | F.coalesce(matches(t) if isinstance(t, str) else t if isinstance(t, Column) else t(entries), F.lit(False))
    return entries.where(found)


def subtree(entries: DataFrame, directory: str) -> DataFrame:
    """A directory's row and everything below."""
    prefix = directory.rstrip("/") + "/"
    return entries.where(F.col("path").startswith(prefix))


# --- aggregates


def duplicates(entries: DataFrame, files_only: bool = False) -> DataFrame:
    """(manifest_id, digest, copies, first_path, wasted): IDs that several rows of a manifest have.

    Null and nil IDs don't count; directories do unless files_only. wasted: bytes of the copies beyond
    the first. Counts and firsts only, so an ID of any frequency is combined map-side.
    """
    rows = entries.where(known_digest(F.col("digest")))
    rows = files(rows) if files_only else rows
    g = rows.groupBy("manifest_id", "digest").agg(F.count(F.lit(1)).alias("copies"), F.min(F.struct("ord", "path")).getField("path").alias("first_path"), F.max("size").alias("size"))
    return g.where("copies > 1").select("manifest_id", "digest", "copies", "first_path", (F.col("size") * (F.col("copies") - 1)).alias("wasted"))


def duplicate_paths(entries: DataFrame, files_only: bool = False) -> DataFrame:
    """(manifest_id, digest, path, copies): every path of the duplicates, as rows instead of lists.

    The groups are written, so that the join is one of plain shuffles and AQE splits a frequent ID's rows.
    """
    groups = written(duplicates(entries, files_only).select("manifest_id", "digest", "copies"), "groups")
    rows = entries.where(known_digest(F.col("digest"))).select("manifest_id", "digest", "path", "ord")
    return rows.join(groups, ["manifest_id", "digest"])


def summary(entries: DataFrame) -> DataFrame:
    """(manifest_id, entries, files, directories, total_size, human_total, unique_ids)."""
    file = ~is_dir()
    return (
        entries.groupBy("manifest_id")
        .agg(
            F.count(F.lit(1)).alias("entries"),
            F.count_if(file).alias("files"),
            F.count_if(~file).alias("directories"),
            F.coalesce(F.sum(F.when(file, F.col("size"))), F.lit(0)).alias("total_size"),
            F.countDistinct(F.when(file & known_digest(F.col("digest")), F.col("digest"))).alias("unique_ids"),
        )
        .withColumn("human_total", human_size(F.col("total_size")))
    )


def summary_text(entries: DataFrame) -> DataFrame:
    """(manifest_id, text): the summary as a line."""
    s = summary(entries)
    number = lambda c: F.format_number(c, 0)
    return s.select("manifest_id", F.concat(number("files"), F.lit(" files, "), number("directories"), F.lit(" directories, "), F.col("human_total"), F.lit(", "), number("unique_ids"), F.lit(" unique IDs")).alias("text"))


def top_directory_sizes(entries: DataFrame) -> DataFrame:
    """(manifest_id, top, files, size) by first path component."""
    top = F.when(F.col("path").contains("/"), F.substring_index("path", "/", 1)).otherwise(F.lit(""))
    return files(entries).groupBy("manifest_id", top.alias("top")).agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("size"), F.lit(0)).alias("size"))


# --- order


def sort_entries(entries: DataFrame) -> DataFrame:
    """Rows in tree order over all manifests; of repeated paths the last row stays. Range-partitioned."""
    return latest(entries).withColumn("_key", tree_key(F.col("path"))).orderBy("manifest_id", "_key").drop("_key")


def numbered(rows: DataFrame, key: Column, *groups: str) -> DataFrame:
    """Rows with ``rank``, their place by key within each group, from 1.

    Rows are range-partitioned by group and key and numbered within each partition; partitions are
    offset by the counts of those before them, which are as few rows as there are partitions. So no
    group, not even that of all rows, is sorted in one task. The partitioned rows are written first, as
    ranges are drawn from a sample.
    """
    placed = rows.withColumn("_key", key).repartitionByRange(*groups, "_key").withColumn("_part", F.spark_partition_id())
    placed = written(placed, "ranges")
    sizes = placed.groupBy(*groups, "_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*groups).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(*groups, "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inner = Window.partitionBy(*groups, "_part").orderBy("_key")
    return placed.withColumn("_i", F.row_number().over(inner)).join(sizes, [*groups, "_part"]).withColumn("rank", F.col("_before") + F.col("_i")).drop("_key", "_part", "_i", "_before")


def ranked(entries: DataFrame) -> DataFrame:
    """(manifest_id, path, rank): place of each path in its manifest's tree order, from 1."""
    rows = latest(entries.select("manifest_id", "path", "ord")).where("manifest_id is not null").select("manifest_id", "path")
    return numbered(rows, tree_key(F.col("path")), "manifest_id")


# --- combining


def implied_directories(entries: DataFrame) -> DataFrame:
    """(manifest_id, path) of directories that paths imply but no row gives."""
    paths = entries.where(F.col("path").isNotNull()).select("manifest_id", "path")
    parents = paths.select("manifest_id", parent_path(F.col("path")).alias("path")).where("path is not null").distinct()
    above = parents.select("manifest_id", F.explode(F.concat(F.array("path"), ancestors(F.col("path")))).alias("path")).distinct()
    return above.join(paths.where(F.col("path").endswith("/")).distinct(), ["manifest_id", "path"], "left_anti")


def with_implied(entries: DataFrame) -> DataFrame:
    """Rows with the implied directories added: mode 0o40755, no size, no time."""
    new = implied_directories(entries)
    made = new.select("manifest_id", "path", entry_name(F.col("path")).alias("name"), parent_path(F.col("path")).alias("parent"), path_depth(F.col("path")).alias("depth"), F.lit(True).alias("is_dir"), F.lit(0o40755).alias("mode"))
    return entries.unionByName(made.select(*[c for c in made.columns if c in entries.columns]), allowMissingColumns=True)


def under_prefix(entries: DataFrame, prefix: str) -> DataFrame:
    """Rows moved below a directory, whose own row is added to each manifest."""
    p = prefix.rstrip("/") + "/"
    moved = entries.withColumn("path", F.concat(F.lit(p), "path")).withColumn("parent", parent_path(F.col("path"))).withColumn("depth", path_depth(F.col("path")))
    return with_implied(moved)


def union_manifests(parts: dict[str, DataFrame], manifest_id: str) -> DataFrame:
    """Several manifests as one, each below a prefix."""
    out = None
    for prefix, rows in parts.items():
        moved = under_prefix(rows.withColumn("manifest_id", F.lit(manifest_id)), prefix)
        out = moved if out is None else out.unionByName(moved, allowMissingColumns=True)
    return out
