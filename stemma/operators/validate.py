"""Rules that a manifest must keep, as issue rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stemma.functions.modes import S_IFDIR, S_IFMT
from stemma.runtime import written

ERROR, WARNING = "error", "warning"
# The file types a mode may have (0: none given).
TYPES = (0, 0o100000, 0o040000, 0o120000, 0o010000, 0o140000, 0o060000, 0o020000)


def _issue(when: Column, severity: str, code: str, message: str) -> Column:
    return F.when(F.coalesce(when, F.lit(False)), F.struct(F.lit(severity).alias("severity"), F.lit(code).alias("code"), F.lit(message).alias("message")))


def row_rules() -> list[Column]:
    """Issues that a row shows by itself."""
    name, base = F.col("name"), F.regexp_replace("name", r"/\z", "")
    kind = F.col("mode").bitwiseAND(F.lit(S_IFMT))
    return [
        _issue(name.isNull() | (name == ""), ERROR, "name_empty", "the name is empty"),
        _issue(name == "/", ERROR, "name_slash", "the name is a slash"),
        _issue(base.isin(".", ".."), ERROR, "name_dots", "the name is . or .."),
        _issue((name != "/") & base.contains("/"), ERROR, "name_separator", "the name holds a path separator"),
        _issue(name.contains("\\"), ERROR, "name_backslash", "the name holds a backslash"),
        _issue(name.contains("\x00"), ERROR, "name_nul", "the name holds a NUL"),
        _issue((kind == S_IFDIR) & ~name.endswith("/"), WARNING, "directory_no_slash", "a directory's name ends without a slash"),
        _issue(~kind.isin(*TYPES), ERROR, "mode_type", "the mode has no known file type"),
        _issue(name.endswith("/") & (kind != 0) & (kind != S_IFDIR), WARNING, "slash_not_directory", "the name ends in a slash but the mode is no directory's"),
        _issue(F.col("size") < 0, ERROR, "size_negative", "the size is negative"),
        _issue(F.col("digest").isNotNull() & (F.octet_length("digest") != 64), ERROR, "digest_length", "the ID hasn't 64 bytes"),
    ]


def row_issues(entries: DataFrame) -> DataFrame:
    """(manifest_id, line, severity, code, message): no shuffle. line is ord + 1."""
    found = F.array_compact(F.array(*row_rules()))
    return entries.select("manifest_id", (F.col("ord") + 1).alias("line"), F.explode(found).alias("_i")).select("manifest_id", "line", "_i.*")


def duplicate_path_issues(entries: DataFrame) -> DataFrame:
    """Each row of a path after its manifest's first. A path of any frequency stays in rows: the firsts
    are found map-side, written and joined back, which lets AQE split a frequent path."""
    rows = entries.where(F.col("path").isNotNull()).select("manifest_id", "path", "ord")
    first = written(rows.groupBy("manifest_id", "path").agg(F.min("ord").alias("_first"), F.count(F.lit(1)).alias("_n")).where("_n > 1"), "firsts")
    again = rows.join(first, ["manifest_id", "path"]).where("ord > _first")
    return again.select("manifest_id", (F.col("ord") + 1).alias("line"), F.lit(ERROR).alias("severity"), F.lit("path_duplicate").alias("code"), F.lit("the path stands in an earlier row").alias("message"))


def depth_jump_issues(entries: DataFrame) -> DataFrame:
    """Rows more than one level deeper than the row before; the first row must be at depth 0.

    Neighbours are compared within blocks of 2**16 rows by ord, whose last rows are joined to the
    next block, so a manifest of any length spreads over tasks.
    """
    rows = entries.where("ord is not null and depth is not null").groupBy("manifest_id", "ord").agg(F.max("depth").alias("depth"))
    rows = rows.withColumn("_b", F.shiftright("ord", 16))
    inner = Window.partitionBy("manifest_id", "_b").orderBy("ord")
    ends = rows.groupBy("manifest_id", "_b").agg(F.max_by("depth", "ord").alias("_end"))
    ends = ends.select("manifest_id", "_b", F.lag("_end").over(Window.partitionBy("manifest_id").orderBy("_b")).alias("_end"))
    before = rows.withColumn("_lag", F.lag("depth").over(inner)).join(ends, ["manifest_id", "_b"])
    jump = F.col("depth") > F.coalesce("_lag", "_end", F.lit(-1)) + 1
    return before.where(jump).select("manifest_id", (F.col("ord") + 1).alias("line"), F.lit(ERROR).alias("severity"), F.lit("depth_jump").alias("code"), F.lit("the depth grows by more than one").alias("message"))


def validate(entries: DataFrame) -> DataFrame:
    """All issues. A manifest is valid if none of its issues is an error."""
    return row_issues(entries).unionByName(duplicate_path_issues(entries)).unionByName(depth_jump_issues(entries))


def mode_string_messages(text: Column) -> Column:
    """Array of what is wrong with a mode string; empty for a valid one, ``-`` or ten dashes."""
    def at(i: int, letters: str, label: str) -> Column:
        return F.when(~F.substring(text, i, 1).isin(*letters), F.lit(f"position {i}: no {label}"))

    parts = [at(1, "-dlpsbc", "file type")]
    for who in range(3):
        parts += [at(2 + 3 * who, "r-", "read flag"), at(3 + 3 * who, "w-", "write flag"), at(4 + 3 * who, "xtT-" if who == 2 else "xsS-", "execute flag")]
    return F.when(text == "-", F.array().cast("array<string>")).when(F.length(text) != 10, F.array(F.lit("the length isn't 10"))).otherwise(F.array_compact(F.array(*parts)))


def id_string_messages(text: Column) -> Column:
    """Array of what is wrong with an ID's text; empty for a valid one or ``-``."""
    from stemma.functions.base58 import ALPHABET, LENGTH, MAX_ID

    shape = F.when(F.length(text) != LENGTH, F.lit("the length isn't 90")), F.when(~text.startswith("c4"), F.lit("it doesn't start with c4"))
    digits = F.when(~F.substring(text, 3, 2**31 - 1).rlike(rf"^[{ALPHABET}]*\z"), F.lit("it holds a character that is no base58 digit"))
    big = F.when((F.length(text) == LENGTH) & text.startswith("c4") & (text > MAX_ID), F.lit("its value is above 512 bits"))
    return F.when(text == "-", F.array().cast("array<string>")).otherwise(F.array_compact(F.array(*shape, digits, big)))
