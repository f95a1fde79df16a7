"""Differences, patches and three-way merges of manifests, keyed by path.

Versions of a manifest are brought side by side in one shuffle: rows are tagged with their version and
grouped by path, which also keeps the last of repeated rows. ``manifest_id`` names the pair or triple
that belongs together, so any number of comparisons run in one plan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stemma.functions.ident import id_text
from stemma.functions.modes import S_IFLNK, S_IFMT, canonical_mode, whole_seconds
from stemma.operators.manifest import with_implied
from stemma.operators.rollup import manifest_ids
from stemma.runtime import prepare, written
from stemma.schema import ATTRIBUTES, ancestors, conflict_path, entry_name, parent_path, path_depth
from stemma.sources.codec import entry_lines

KEY = ("manifest_id", "path")


# What the comparisons read of a row, so that the rest needn't be sent along.
DIFF_FIELDS = ("mode", "ts", "size", "digest", "target")
MERGE_FIELDS = ("mode", "digest", "target", "flow_direction", "flow_target")


def beside(fields: tuple[str, ...] = ATTRIBUTES, **versions: DataFrame) -> DataFrame:
    """(manifest_id, path, one struct of fields a version): null where a version lacks the path."""
    tagged = None
    prepare(next(iter(versions.values())).sparkSession)
    for name, rows in versions.items():
        r = rows.where(F.col("path").isNotNull()).select(*KEY, F.struct(*fields).alias("_row"), F.coalesce("ord", F.lit(-(2**62))).alias("_ord"), F.lit(name).alias("_version"))
        tagged = r if tagged is None else tagged.unionByName(r)
    pick = [F.max_by(F.when(F.col("_version") == v, F.col("_row")), F.when(F.col("_version") == v, F.col("_ord"))).alias(v) for v in versions]
    return tagged.groupBy(*KEY).agg(*pick)


def _same(a: str, b: str, *fields: str) -> Column:
    out = F.lit(True)
    for f in fields:
        x, y = F.col(f"{a}.{f}"), F.col(f"{b}.{f}")
        if f == "mode":
            x, y = canonical_mode(x), canonical_mode(y)
        elif f == "ts":
            x, y = whole_seconds(x), whole_seconds(y)
        elif f in ("target", "flow_target", "flow_direction"):
            x, y = F.coalesce(x, F.lit("")), F.coalesce(y, F.lit(""))
        elif f == "hard_link":
            x, y = F.coalesce(x, F.lit(0)), F.coalesce(y, F.lit(0))
        out = out & x.eqNullSafe(y)
    return out


def equal_entries(a: str, b: str) -> Column:
    """Equality in a difference: with both IDs, by ID and mode; else by mode, size, time and target."""
    both = F.col(f"{a}.digest").isNotNull() & F.col(f"{b}.digest").isNotNull()
    return F.when(both, _same(a, b, "digest", "mode")).otherwise(_same(a, b, "mode", "size", "ts", "target"))


def identical_entries(a: str, b: str) -> Column:
    """Equality in a patch: all attributes."""
    return _same(a, b, "name", "mode", "ts", "size", "digest", "target", "hard_link", "flow_direction", "flow_target")


def merge_equal(a: str, b: str) -> Column:
    """Equality in a merge: directories by flow, symbolic links by target, files by ID."""
    link = F.coalesce(F.col(f"{a}.mode").bitwiseAND(F.lit(S_IFMT)) == S_IFLNK, F.lit(False)) & F.coalesce(F.col(f"{b}.mode").bitwiseAND(F.lit(S_IFMT)) == S_IFLNK, F.lit(False))
    return F.when(F.col("path").endswith("/"), _same(a, b, "flow_direction", "flow_target")).when(link, _same(a, b, "target")).otherwise(_same(a, b, "digest"))


def diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """(manifest_id, path, status, old, new): added, removed, modified or same; old and new hold DIFF_FIELDS."""
    b = beside(DIFF_FIELDS, old=old, new=new)
    status = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").when(equal_entries("old", "new"), "same").otherwise("modified")
    return b.select(*KEY, status.alias("status"), "old", "new")


def diff_counts(changes: DataFrame) -> DataFrame:
    return changes.groupBy("manifest_id").agg(*[F.count_if(F.col("status") == s).alias(s) for s in ("added", "removed", "modified", "same")])


def by_top_directory(changes: DataFrame) -> DataFrame:
    """(manifest_id, top, added, removed, modified): changes by first path component, '' for the root."""
    top = F.when(F.col("path").contains("/"), F.substring_index("path", "/", 1)).otherwise(F.lit(""))
    return changes.where("status <> 'same'").groupBy("manifest_id", top.alias("top")).agg(*[F.count_if(F.col("status") == s).alias(s) for s in ("added", "removed", "modified")])


def renames(changes: DataFrame, consume: bool = True) -> DataFrame:
    """(manifest_id, old_path, new_path): removed rows met again, by ID, among the added ones.

    Of several removed rows with an ID the last one counts. With consume it goes to the first added row
    of that ID only, else to each of them; then the removed rows, one an ID, are written, so that AQE
    splits a frequent ID's added rows.
    """
    gone = changes.where((F.col("status") == "removed") & F.col("old.digest").isNotNull()).groupBy("manifest_id", F.col("old.digest").alias("digest")).agg(F.max("path").alias("old_path"))
    new = changes.where((F.col("status") == "added") & F.col("new.digest").isNotNull()).select("manifest_id", F.col("new.digest").alias("digest"), F.col("path").alias("new_path"))
    if consume:
        new = new.groupBy("manifest_id", "digest").agg(F.min("new_path").alias("new_path"))
    else:
        gone = written(gone, "gone")
    return gone.join(new, ["manifest_id", "digest"]).select("manifest_id", "old_path", "new_path")


# --- patches


def patch(old: DataFrame, new: DataFrame) -> DataFrame:
    """(manifest_id, path, attributes): rows of a patch from old to new.

    A new or changed path with its new row, a removed one with its old row once more. A directory whose
    row is gone while paths below it are still listed is not removed, as that would take them along; the
    patched version keeps its row.
    """
    b = beside(old=old, new=new)
    changed = F.col("old").isNull() | F.col("new").isNull() | ~identical_entries("old", "new")
    parents = new.select("manifest_id", parent_path(F.col("path")).alias("path")).where("path is not null").distinct()
    implied = parents.select("manifest_id", F.explode(F.concat(F.array("path"), ancestors(F.col("path")))).alias("path")).distinct()
    b = b.where(changed).join(implied.withColumn("_implied", F.lit(True)), list(KEY), "left").where("new is not null or _implied is null")
    return b.select(*KEY, F.coalesce("new", "old").alias("_r")).select(*KEY, "_r.*")


def apply_patch(base: DataFrame, patch_rows: DataFrame) -> DataFrame:
    """Base rows with a patch applied: identical rows go, other ones replace or join.

    A directory whose own row is removed takes everything below with it, patch rows included: each path
    is matched with the removed directories among its ancestors, an equality join. Context rows of patch
    texts (see patch_lines) change nothing.
    """
    b = beside(base=base, patch=patch_rows.where(~is_context()).withColumn("ord", F.lit(0).cast("long")))
    dropped = F.col("base").isNotNull() & F.col("patch").isNotNull() & identical_entries("base", "patch")
    b = written(b.withColumn("_drop", dropped), "patch")
    gone = b.where(F.col("_drop") & F.col("path").endswith("/")).select("manifest_id", F.col("path").alias("_gone"))
    stay = b.where("not _drop")
    # directories below a removed one are found per distinct parent directory
    parents = stay.select("manifest_id", parent_path(F.col("path")).alias("_parent")).where("_parent is not null").distinct()
    lost = parents.select("manifest_id", "_parent", F.explode(F.concat(F.array("_parent"), ancestors(F.col("_parent")))).alias("_gone")).join(gone, ["manifest_id", "_gone"], "left_semi").select("manifest_id", "_parent").distinct()
    stay = stay.withColumn("_parent", parent_path(F.col("path"))).join(lost, ["manifest_id", "_parent"], "left_anti")
    return _rows(stay.select(*KEY, F.coalesce("patch", "base").alias("_r")))


def _rows(keyed: DataFrame) -> DataFrame:
    """Full rows of (manifest_id, path, _r): place columns derived from the path."""
    return keyed.select(
        "manifest_id", "path", parent_path(F.col("path")).alias("parent"), path_depth(F.col("path")).alias("depth"), F.lit(0).cast("long").alias("ord"), "_r.*"
    )


def is_context() -> Column:
    """A directory row with an ungrouped hard link, which no real directory has: it only places the rows
    below it in a patch text."""
    return F.col("path").endswith("/") & (F.coalesce(F.col("hard_link"), F.lit(0)) == -1)


def patch_lines(old: DataFrame, new: DataFrame) -> DataFrame:
    """(manifest_id, key, line): a patch's text, by key. The first line is the ID of the old version.

    Unchanged directories above changed rows are given as context rows, so that the text decodes to the
    right paths.
    """
    p = written(patch(old, new), "patch")
    above = p.select("manifest_id", F.explode(ancestors(F.col("path"))).alias("path")).distinct().join(p.select(*KEY), list(KEY), "left_anti")
    context = above.select(*KEY, entry_name(F.col("path")).alias("name"), F.lit(True).alias("is_dir"), F.lit(-1).alias("hard_link"))
    rows = p.unionByName(context, allowMissingColumns=True).withColumns({"section_idx": F.lit(0), "ord": F.lit(0).cast("long"), "depth": path_depth(F.col("path")), "parent": parent_path(F.col("path"))})
    lines = entry_lines(rows).select("manifest_id", "key", "line")
    first = manifest_ids(old).select("manifest_id", F.lit(None).cast(lines.schema["key"].dataType).alias("key"), id_text("digest").alias("line"))
    return lines.unionByName(first)


def patch_text(old: DataFrame, new: DataFrame) -> str:
    """Patch text of one manifest on the driver; appended to the old version's text it makes a chain."""
    return "".join(r.line + "\n" for r in patch_lines(old, new).orderBy(F.col("key").asc_nulls_first()).select("line").toLocalIterator())


def sections(entries: DataFrame) -> list[int]:
    return sorted(r[0] for r in entries.select("section_idx").distinct().collect())


def resolve_chain(entries: DataFrame, upto: int | None = None) -> DataFrame:
    """Final state of manifests whose rows carry section_idx (0: base, above: patches, in order)."""
    out = entries.where("section_idx = 0")
    for k in sections(entries):
        if k > 0 and (upto is None or k <= upto):
            out = apply_patch(out, entries.where(F.col("section_idx") == k))
    return out


def log_chain(entries: DataFrame, bits: int = 512) -> DataFrame:
    """(manifest_id, index, added, removed, modified, is_base, entry_count, digest) per section, index from 1.
    digest: ID of the manifest in this version. bits: width of its hash, if not that of IDs."""
    state, out = entries.where("section_idx = 0").withColumns({"depth": path_depth(F.col("path")), "parent": parent_path(F.col("path"))}), None
    for k in sections(entries):
        if k == 0:
            log = state.groupBy("manifest_id").agg(F.countDistinct("path").alias("entry_count"))
            of = state.select("manifest_id").distinct()
            log = log.select("manifest_id", F.lit(1).alias("index"), F.col("entry_count").alias("added"), F.lit(0).cast("long").alias("removed"), F.lit(0).cast("long").alias("modified"), F.lit(True).alias("is_base"), "entry_count")
        else:
            here = entries.where(F.col("section_idx") == k)
            after = written(apply_patch(state, here), "chain")
            of = here.select("manifest_id").distinct()  # manifests without this section don't log it
            b = beside(old=state.join(of, "manifest_id", "left_semi"), new=after.join(of, "manifest_id", "left_semi"))
            log = b.groupBy("manifest_id").agg(
                F.lit(k + 1).alias("index"),
                F.count_if(F.col("old").isNull()).alias("added"),
                F.count_if(F.col("new").isNull()).alias("removed"),
                F.count_if(F.col("old").isNotNull() & F.col("new").isNotNull() & ~identical_entries("old", "new")).alias("modified"),
                F.lit(False).alias("is_base"),
                F.count("new").alias("entry_count"),
            )
            state = after
        log = log.join(manifest_ids(state.join(of, "manifest_id", "left_semi"), bits), "manifest_id", "left")
        out = log if out is None else out.unionByName(log)
    return out


# --- merge


def merge_outcomes(base: DataFrame | None, local: DataFrame, remote: DataFrame, fields: tuple[str, ...] = MERGE_FIELDS) -> DataFrame:
    """(manifest_id, path, base, local, remote, outcome), the sides with fields: take_local, take_remote, take_base, deleted, or
    conflict (changed differently on both sides, or deleted on one and changed on the other)."""
    none = local.where(F.lit(False))
    m = beside(fields, base=none if base is None else base, local=local, remote=remote)
    b, l, r = (F.col(x).isNotNull() for x in ("base", "local", "remote"))
    bl, br, lr = merge_equal("base", "local"), merge_equal("base", "remote"), merge_equal("local", "remote")
    outcome = (
        F.when(~b & l & ~r, "take_local")
        .when(~b & ~l & r, "take_remote")
        .when(~b, F.when(lr, "take_local").otherwise("conflict"))
        .when(l & r, F.when(bl & br, "take_base").when(br, "take_local").when(bl, "take_remote").when(lr, "take_local").otherwise("conflict"))
        .when(l, F.when(bl, "deleted").otherwise("conflict"))
        .when(r, F.when(br, "deleted").otherwise("conflict"))
        .otherwise("deleted")
    )
    return m.withColumn("outcome", outcome)


def merge(base: DataFrame | None, local: DataFrame, remote: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, conflicts). In a conflict the later row keeps the path, local at equal times; the other one
    goes beside it as ``.conflict``. If one side had deleted the path, the other one's row stays.
    Directories that paths imply are added."""
    m = written(merge_outcomes(base, local, remote, ATTRIBUTES), "merge")
    epoch = F.timestamp_seconds(F.lit(0))
    remote_wins = F.coalesce(F.col("remote.ts"), epoch) > F.coalesce(F.col("local.ts"), epoch)
    two = F.col("local").isNotNull() & F.col("remote").isNotNull()
    side = F.when(F.col("outcome") == "take_base", F.col("base")).when(F.col("outcome") == "take_local", F.col("local")).when(F.col("outcome") == "take_remote", F.col("remote"))
    winner = F.when(F.col("outcome") != "conflict", side).when(~two, F.coalesce("local", "remote")).when(remote_wins, F.col("remote")).otherwise(F.col("local"))
    loser = F.when((F.col("outcome") == "conflict") & two, F.when(remote_wins, F.col("local")).otherwise(F.col("remote")))
    kept = m.where("outcome <> 'deleted'").select("manifest_id", F.explode(F.array_compact(F.array(F.struct(F.col("path").alias("p"), winner.alias("r")), F.when(loser.isNotNull(), F.struct(conflict_path(F.col("path")).alias("p"), loser.alias("r")))))).alias("_x"))
    rows = kept.select("manifest_id", F.col("_x.p").alias("path"), F.col("_x.r").withField("name", entry_name(F.col("_x.p"))).alias("_r"))
    return with_implied(_rows(rows)), m.where("outcome = 'conflict'").select(*KEY, "local", "remote")
