"""The manifest row and path helpers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ENTRY = (
    "manifest_id string, section_idx int, ord long, path string, parent string, name string, depth int, is_dir boolean, mode int, ts timestamp, size long, digest binary, "
    "target string, hard_link int, flow_direction string, flow_target string, is_sequence boolean, pattern string"
)
#: Columns of a row beside its place (manifest, section, order, path).
ATTRIBUTES = ("name", "is_dir", "mode", "ts", "size", "digest", "target", "hard_link", "flow_direction", "flow_target", "is_sequence", "pattern")
NIL = bytes(64)

# Every path is stored with a slash at the end of directories; that form is the key.


def display_path(path: Column) -> Column:
    """Path without the slash that marks a directory."""
    return F.regexp_replace(path, r"/+\z", "")


def path_depth(path: Column) -> Column:
    """Number of directories above; the slash at the end doesn't count."""
    return F.length(F.regexp_replace(display_path(path), "[^/]", ""))


def entry_name(path: Column) -> Column:
    """Last component, with its slash if it is a directory."""
    return F.regexp_extract(path, r"([^/]*/?)\z", 1)


def parent_path(path: Column) -> Column:
    """Path of the directory above with its slash, null at the top."""
    return F.nullif(F.regexp_extract(path, r"(?s)^(.*/)?[^/]+/?\z", 1), F.lit(""))


def conflict_path(path: Column) -> Column:
    """Path under which the losing row of a conflict is kept."""
    return F.regexp_replace(path, r"(?s)^(.*?)(/?)\z", "$1.conflict$2")


def components(path: Column) -> Column:
    """Path components; directories keep their slash."""
    return F.regexp_extract_all(path, F.lit("([^/]+/?)"), F.lit(1))


def ancestors(path: Column) -> Column:
    """Paths of all directories above, outermost first."""
    parts = F.regexp_extract_all(F.coalesce(parent_path(path), F.lit("")), F.lit("([^/]+/)"), F.lit(1))
    return F.when(F.size(parts) == 0, F.array().cast("array<string>")).otherwise(
        F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), ""))
    )


def latest(entries: DataFrame, *keys: str) -> DataFrame:
    """One row a key (default manifest and path): the one with the greatest ord; repeats combine map-side."""
    keys = keys or ("manifest_id", "path")
    rest = [c for c in entries.columns if c not in keys]
    order = F.coalesce("ord", F.lit(-(2**62)))
    return entries.where(F.col("path").isNotNull()).groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_r")).select(*keys, "_r.*")


def known_digest(digest: Column) -> Column:
    """Neither null nor nil."""
    return digest.isNotNull() & (digest != F.lit(NIL))
