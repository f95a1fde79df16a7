"""Queries of the manifest operators over the whole entry tables.

Consecutive listings of a tree are the versions: ``manifest_id`` of a comparison is that of the later
one. ``mirror_entries`` stands for a second place.
"""

from __future__ import annotations

import atexit
import os
import shutil
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stemma.functions import fmt, ident, names
from stemma.operators import manifest as M
from stemma.operators import rollup, trees, validate, versions
from stemma.operators.snapshots import listings
from stemma.runtime import shared_folder, table, written
from stemma.schema import conflict_path, entry_name, known_digest, latest, path_depth
from stemma.sources import codec

QUERIES, SQL = {}, {}


def query(sql: str | None = None, hexed: tuple[str, ...] = ()):
    """Registers a query. hexed: binary columns, which leave as hexadecimal text so that they compare anywhere."""

    def add(f):
        def run(spark, folder):
            df = f(spark, folder)
            return df.withColumns({c: ident.hex_text(F.col(c)) for c in hexed}) if hexed else df

        run.__doc__ = f.__doc__
        QUERIES[f.__name__] = run
        if sql:
            outer = f"select * replace ({', '.join(f'lower(hex({c})) as {c}' for c in hexed)}) from ({sql})" if hexed else sql
            SQL[f.__name__] = outer.replace("{LAST}", LAST).replace("{MLAST}", LAST.replace("entries", "mirror_entries")).replace("{PAIRS}", PAIRS).replace("{DIFF}", DIFF)
        return f

    return add


# Plain SQL: one row a path, the last one of a listing; consecutive listings; their differences.
LAST = "(select * exclude (rn) from (select e.*, row_number() over (partition by manifest_id, path order by ord desc) rn from entries e where path is not null) where rn = 1)"
PAIRS = (
    "(select manifest_id, prev, prev2 from (select manifest_id, lag(manifest_id) over (partition by tree order by seq, manifest_id) prev,"
    " lag(manifest_id, 2) over (partition by tree order by seq, manifest_id) prev2 from"
    " (select manifest_id, min(tree) tree, min(seq) seq from manifests where tree is not null and seq is not null group by manifest_id)) where prev is not null)"
)
_CM = "case when ({x}.mode & 61440) = 32768 then {x}.mode & 4095 else {x}.mode end"
_N, _O = _CM.replace("{x}", "n"), _CM.replace("{x}", "o")
DIFF = (
    "(select coalesce(n.mid, o.mid) as manifest_id, coalesce(n.path, o.path) as path, o.digest as old_digest, n.digest as new_digest,"
    " case when o.path is null then 'added' when n.path is null then 'removed'"
    f" when n.digest is not null and o.digest is not null then case when n.digest = o.digest and {_N} is not distinct from {_O} then 'same' else 'modified' end"
    f" when {_N} is not distinct from {_O} and n.size is not distinct from o.size and date_trunc('second', n.ts) is not distinct from date_trunc('second', o.ts)"
    " and coalesce(n.target, '') = coalesce(o.target, '') then 'same' else 'modified' end as status"
    f" from (select p.manifest_id as mid, e.* from {PAIRS} p join {LAST} e on e.manifest_id = p.manifest_id) n"
    f" full outer join (select p.manifest_id as mid, e.* from {PAIRS} p join {LAST} e on e.manifest_id = p.prev) o on n.mid = o.mid and n.path = o.path)"
)


def _entries(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "entries")


def _versions(spark: SparkSession, folder: str, back: int = 1) -> list[DataFrame]:
    """Rows of each listing and of its predecessors, under the listing's manifest_id, newest first."""
    of = listings(table(spark, folder, "manifests"))
    w = Window.partitionBy("tree").orderBy("pos")
    chain = of.select("manifest_id", *[F.lag("manifest_id", k).over(w).alias(f"_p{k}") for k in range(1, back + 1)]).where(f"_p{back} is not null")
    e = _entries(spark, folder)
    # written, so that its size is known where it is joined
    chain = written(chain, "chain")
    out = [e.join(chain.select("manifest_id"), "manifest_id")]
    for k in range(1, back + 1):
        link = chain.select(F.col("manifest_id").alias("_new"), F.col(f"_p{k}").alias("manifest_id"))
        out.append(e.join(link, "manifest_id").drop("manifest_id").withColumnRenamed("_new", "manifest_id"))
    return out


def _changes(spark: SparkSession, folder: str) -> DataFrame:
    new, old = _versions(spark, folder)
    return versions.diff(old, new)


# --- identity

@query()
def identify_contents(spark, folder):
    """ID of every document's text."""
    return table(spark, folder, "documents").select("doc_id", ident.id_text(ident.digest_of(F.coalesce("text", F.lit("")))).alias("id"))


@query("select count(distinct digest) as ids, count(distinct digest) as same from entries where digest is not null")
def id_roundtrip(spark, folder):
    d = _entries(spark, folder).where("digest is not null").select("digest").distinct()
    back = d.withColumn("text", ident.id_text("digest")).withColumn("back", ident.id_digest("text"))
    return back.agg(F.count(F.lit(1)).alias("ids"), F.count_if(F.col("back").eqNullSafe(F.col("digest"))).alias("same"))


@query("select count(*) filter (where digest = unhex(repeat('00', 64))) as nil, count(*) filter (where digest is null) as none, min(lower(hex(digest))) as least, max(lower(hex(digest))) as greatest from entries")
def digest_order(spark, folder):
    d = F.col("digest")
    return _entries(spark, folder).agg(F.count_if(ident.is_nil(d)).alias("nil"), F.count_if(d.isNull()).alias("none"), ident.hex_text(F.min(d)).alias("least"), ident.hex_text(F.max(d)).alias("greatest"))


@query(hexed=("tree_digest",))
def manifest_set_identity(spark, folder):
    """Set identity of each manifest's digests."""
    return ident.set_identity(_entries(spark, folder).select("manifest_id", "digest"), "manifest_id")


@query(hexed=("digest",))
def manifest_identity(spark, folder):
    return rollup.manifest_ids(_entries(spark, folder))


# --- navigation and filters


@query("select manifest_id, ord, rtrim(path, '/') as display_path from entries")
def flat_entries(spark, folder):
    return M.flat_entries(_entries(spark, folder)).select("manifest_id", "ord", "display_path")


@query("select manifest_id, ord, path from entries where not (coalesce(name like '%/', false) or coalesce((mode & 61440) = 16384, false))")
def files(spark, folder):
    return M.files(_entries(spark, folder)).select("manifest_id", "ord", "path")


@query("select manifest_id, ord, path from entries where coalesce(name like '%/', false) or coalesce((mode & 61440) = 16384, false)")
def directories(spark, folder):
    return M.directories(_entries(spark, folder)).select("manifest_id", "ord", "path")


@query("select manifest_id, path, depth_of, name_of, conflict from (select distinct manifest_id, path, length(regexp_replace(rtrim(path, '/'), '[^/]', '', 'g')) as depth_of, regexp_extract(path, '([^/]*/?)$', 1) as name_of, case when path like '%/' then rtrim(path, '/') || '.conflict/' else path || '.conflict' end as conflict from entries)")
def path_helpers(spark, folder):
    p = F.col("path")
    e = _entries(spark, folder).select("manifest_id", "path").distinct()
    return e.select("manifest_id", "path", path_depth(p).cast("long").alias("depth_of"), entry_name(p).alias("name_of"), conflict_path(p).alias("conflict"))


@query("select manifest_id, count(*) as symlinks from entries where (mode & 61440) = 40960 group by manifest_id")
def symlinks(spark, folder):
    return _entries(spark, folder).where(M.is_symlink()).groupBy("manifest_id").agg(F.count(F.lit(1)).alias("symlinks"))


@query("select manifest_id, count(*) filter (where mode is null or ts is null or size is null or digest is null) as with_null, count(*) filter (where coalesce(flow_direction, '') <> '') as flow_linked, count(*) filter (where regexp_matches(path, '(^|/)[.]')) as hidden from entries group by manifest_id")
def entry_predicates(spark, folder):
    return _entries(spark, folder).groupBy("manifest_id").agg(F.count_if(M.has_null_fields()).alias("with_null"), F.count_if(M.is_flow_linked()).alias("flow_linked"), F.count_if(M.is_hidden()).alias("hidden"))


@query("select manifest_id, ord, path from entries where rtrim(path, '/') glob '*_[b-m]*.0[!0]?.*' or regexp_matches(path, '[.]exr$')")
def filter_glob(spark, folder):
    e = _entries(spark, folder)
    return M.filter_entries(e, "*_[b-m]*.0[!0]?.*", "*.exr").select("manifest_id", "ord", "path")


@query("select manifest_id, ord, path, size from entries where size > 1000000 and depth >= 2 and target is null")
def filter_predicate(spark, folder):
    return M.filter_entries(_entries(spark, folder), lambda d: (d.size > 1_000_000) & (d.depth >= 2) & d.target.isNull()).select("manifest_id", "ord", "path", "size")


@query("select manifest_id, ord, path from entries where starts_with(path, 'shots/')")
def subtree(spark, folder):
    return M.subtree(_entries(spark, folder), "shots").select("manifest_id", "ord", "path")


@query("select manifest_id, ord, path, size from (select *, row_number() over (partition by manifest_id order by ord) k from entries where rtrim(path, '/') = 'shots') where k = 1")
def lookup_path(spark, folder):
    return M.by_path(_entries(spark, folder), "shots").select("manifest_id", "ord", "path", "size").distinct()


# --- aggregates


@query("select manifest_id, count(*) as n, min(path) as path from entries where ord = 5 group by manifest_id")
def at_index(spark, folder):
    return M.at_index(_entries(spark, folder), 5).groupBy("manifest_id").agg(F.count(F.lit(1)).alias("n"), F.min("path").alias("path"))


_SUMMARY = """select manifest_id, count(*) as entries, count(*) filter (where not d) as files, count(*) filter (where d) as directories,
  coalesce(sum(size) filter (where not d), 0)::bigint as total_size, count(distinct digest) filter (where not d and digest <> unhex(repeat('00', 64))) as unique_ids
  from (select *, coalesce(name like '%/', false) or coalesce((mode & 61440) = 16384, false) as d from entries) group by manifest_id"""


@query(_SUMMARY)
def summary(spark, folder):
    return M.summary(_entries(spark, folder)).drop("human_total")


@query("select manifest_id, case when total_size < 1024 then total_size || ' B' when total_size < 1048576 then printf('%.1f KB', total_size / 1024.0) when total_size < 1073741824 then printf('%.1f MB', total_size / 1048576.0) when total_size < 1099511627776 then printf('%.1f GB', total_size / 1073741824.0) else printf('%.1f TB', total_size / 1099511627776.0) end as human_total from (" + _SUMMARY + ")")
def human_size(spark, folder):
    return M.summary(_entries(spark, folder)).select("manifest_id", "human_total")


_DUP = """select manifest_id, digest, count(*) as copies, arg_min(path, {'o': ord, 'p': path}) as first_path, max(size) * (count(*) - 1) as wasted
  from entries where digest is not null and digest <> unhex(repeat('00', 64)) group by manifest_id, digest having count(*) > 1"""


@query(_DUP, hexed=("digest",))
def duplicates(spark, folder):
    return M.duplicates(_entries(spark, folder))


@query(f"select manifest_id, sum(wasted)::bigint as wasted from ({_DUP}) group by manifest_id")
def wasted_bytes(spark, folder):
    return M.duplicates(_entries(spark, folder)).groupBy("manifest_id").agg(F.sum("wasted").alias("wasted"))


@query("select digest, count(*) as copies, min(path) as path from entries where digest is not null and digest <> unhex(repeat('00', 64)) group by digest order by copies desc, digest limit 20", hexed=("digest",))
def top_duplicates(spark, folder):
    g = _entries(spark, folder).where(known_digest(F.col("digest"))).groupBy("digest").agg(F.count(F.lit(1)).alias("copies"), F.min("path").alias("path"))
    return g.orderBy(F.desc("copies"), "digest").limit(20)


@query(f"select e.manifest_id, e.path, e.ord, g.copies, e.digest from entries e join ({_DUP}) g on e.manifest_id = g.manifest_id and e.digest = g.digest", hexed=("digest",))
def duplicate_paths_by_id(spark, folder):
    return M.duplicate_paths(_entries(spark, folder))


@query("select manifest_id, case when contains(path, '/') then split_part(path, '/', 1) else '' end as top, count(*) as files, coalesce(sum(size), 0)::bigint as size from entries where not (coalesce(name like '%/', false) or coalesce((mode & 61440) = 16384, false)) group by all")
def top_directory_sizes(spark, folder):
    return M.top_directory_sizes(_entries(spark, folder))


# --- order

_PARTS = "list_transform(regexp_extract_all(c, '([0-9]+|[^0-9]+)', 1), lambda x: case when regexp_matches(x, '^[0-9]') then {'k': 1, 't': '', 'n': length(ltrim(x, '0')), 'd': ltrim(x, '0'), 'l': length(x)} else {'k': 0, 't': x, 'n': 0, 'd': '', 'l': 0} end)"


@query("select manifest_id, path, row_number() over (partition by manifest_id order by list_transform(regexp_extract_all(path, '([^/]+/?)', 1), lambda c: {'dir': case when c like '%/' then 1 else 0 end, 'key': " + _PARTS + "})) as rank from {LAST}")
def sort_entries(spark, folder):
    return M.ranked(_entries(spark, folder))


@query("select name, row_number() over (order by " + _PARTS.replace("(c,", "(name,") + ") as rank from (select distinct name from entries)")
def natural_sort(spark, folder):
    return M.numbered(_entries(spark, folder).select("name").distinct(), fmt.natural_key(F.col("name"))).select("name", "rank")


# --- versions


@query("select manifest_id, path, status from {DIFF}")
def diff_status(spark, folder):
    return _changes(spark, folder).select("manifest_id", "path", "status")


@query("select manifest_id, count(*) filter (where status = 'added') as added, count(*) filter (where status = 'removed') as removed, count(*) filter (where status = 'modified') as modified, count(*) filter (where status = 'same') as same from {DIFF} group by manifest_id")
def diff_counts(spark, folder):
    return versions.diff_counts(_changes(spark, folder))


@query("select manifest_id, case when contains(path, '/') then split_part(path, '/', 1) else '' end as top, count(*) filter (where status = 'added') as added, count(*) filter (where status = 'removed') as removed, count(*) filter (where status = 'modified') as modified from {DIFF} where status <> 'same' group by all")
def diff_by_top_directory(spark, folder):
    return versions.by_top_directory(_changes(spark, folder))


_GONE = "(select manifest_id, old_digest as digest, max(path) as old_path from {DIFF} where status = 'removed' and old_digest is not null group by all)"


@query(f"select g.manifest_id, g.old_path, n.new_path from {_GONE} g join (select manifest_id, new_digest as digest, min(path) as new_path from {{DIFF}} where status = 'added' and new_digest is not null group by all) n on g.manifest_id = n.manifest_id and g.digest = n.digest")
def renames(spark, folder):
    return versions.renames(written(_changes(spark, folder), "changes"))


@query(f"select g.manifest_id, g.old_path, n.path as new_path from {_GONE} g join {{DIFF}} n on g.manifest_id = n.manifest_id and g.digest = n.new_digest where n.status = 'added'")
def renames_to_all(spark, folder):
    return versions.renames(written(_changes(spark, folder), "changes"), consume=False)


_IDENT = " and ".join(
    [f"{_N} is not distinct from {_O}", "n.name is not distinct from o.name", "date_trunc('second', n.ts) is not distinct from date_trunc('second', o.ts)", "n.size is not distinct from o.size", "n.digest is not distinct from o.digest"]
    + [f"coalesce(n.{f}, '') = coalesce(o.{f}, '')" for f in ("target", "flow_direction", "flow_target")]
    + ["coalesce(n.hard_link, 0) = coalesce(o.hard_link, 0)"]
)
_BESIDE = "from (select p.manifest_id as mid, e.* from {PAIRS} p join {LAST} e on e.manifest_id = p.manifest_id) n full outer join (select p.manifest_id as mid, e.* from {PAIRS} p join {LAST} e on e.manifest_id = p.prev) o on n.mid = o.mid and n.path = o.path"


# A directory whose row is gone while paths below it are listed.
_KEPT = "{o}.path like '%/' and exists (select 1 from {LAST} x where x.manifest_id = {o}.mid and starts_with(x.path, {o}.path))"


@query(f"select coalesce(n.mid, o.mid) as manifest_id, coalesce(n.path, o.path) as path, case when n.path is null then o.size else n.size end as size {_BESIDE} where n.path is null and not ({_KEPT.replace("{o}", "o")}) or o.path is null or n.path is not null and not ({_IDENT})")
def patch_rows(spark, folder):
    new, old = _versions(spark, folder)
    return versions.patch(old, new).select("manifest_id", "path", "size")


@query(
    "select p.manifest_id, e.path, e.size, e.digest from {PAIRS} p join {LAST} e on e.manifest_id = p.manifest_id"
    f" union all select o.mid, o.path, o.size, o.digest {_BESIDE} where n.path is null and {_KEPT.replace('{o}', 'o')}", hexed=("digest",)
)
def apply_patch(spark, folder):
    """A patch of consecutive listings, applied to the earlier one, gives the later one and the directories
    that it lists paths below but not themselves."""
    new, old = _versions(spark, folder)
    patch = versions.patch(old, new)
    return versions.apply_patch(old, patch).select("manifest_id", "path", "size", "digest")


def _chain(spark, folder):
    """Base and two patches of every three consecutive listings, as sections of one manifest."""
    new, mid, old = _versions(spark, folder, 2)
    cols = ("manifest_id", "path", "name", "is_dir", "mode", "ts", "size", "digest", "target", "hard_link", "flow_direction", "flow_target", "is_sequence", "pattern")
    part = lambda d, k: d.select(*cols).withColumns({"section_idx": F.lit(k), "ord": F.lit(0).cast("long")})
    base = latest(old).select(*cols)
    return written(part(base, 0).unionByName(part(versions.patch(old, mid), 1)).unionByName(part(versions.patch(mid, new), 2)), "chain")


# The three states of a chain: o0, o1, o2 are the listings; k1, k2 directories that stay because paths below
# them are listed; g2 the directories that go, with all below; s1, s2 the states after each patch.
_STATES = """with p as (select * from {PAIRS} where prev2 is not null),
o0 as (select p.manifest_id as mid, e.* from p join {LAST} e on e.manifest_id = p.prev2), o1 as (select p.manifest_id as mid, e.* from p join {LAST} e on e.manifest_id = p.prev), o2 as (select p.manifest_id as mid, e.* from p join {LAST} e on e.manifest_id = p.manifest_id),
d1 as (select * from o0 where path like '%/' and not exists (select 1 from o1 where o1.mid = o0.mid and o1.path = o0.path)), k1 as (select * from d1 where exists (select 1 from o1 where o1.mid = d1.mid and starts_with(o1.path, d1.path))),
d2 as (select * from o1 where path like '%/' and not exists (select 1 from o2 where o2.mid = o1.mid and o2.path = o1.path)), k2 as (select * from d2 where exists (select 1 from o2 where o2.mid = d2.mid and starts_with(o2.path, d2.path))),
g2 as (select * from d2 where not exists (select 1 from o2 where o2.mid = d2.mid and starts_with(o2.path, d2.path))),
s1 as (select * from o1 union all select * from k1),
s2 as (select * from o2 union all select * from k2 union all select * from k1 where not exists (select 1 from o2 where o2.mid = k1.mid and o2.path = k1.path) and not exists (select 1 from g2 where g2.mid = k1.mid and starts_with(k1.path, g2.path)))
"""


@query(_STATES + "select mid as manifest_id, path, size, digest from s2", hexed=("digest",))
def resolve_chain(spark, folder):
    return versions.resolve_chain(_chain(spark, folder)).select("manifest_id", "path", "size", "digest")


def _log_step(index: int, old: str, new: str) -> str:
    return (
        f" union all select coalesce(n.mid, o.mid), {index}, count(*) filter (where o.path is null), count(*) filter (where n.path is null), count(*) filter (where n.path is not null and o.path is not null and not ({_IDENT})), false, count(n.path)"
        f" from {new} n full outer join {old} o on n.mid = o.mid and n.path = o.path group by all"
    )


@query(_STATES + "select mid as manifest_id, 1 as index, count(*) as added, 0 as removed, 0 as modified, true as is_base, count(*) as entry_count from o0 group by mid" + _log_step(2, "o0", "s1") + _log_step(3, "s1", "s2"))
def log_chain(spark, folder):
    return versions.log_chain(_chain(spark, folder)).drop("digest")


_MEQ = "case when coalesce(l.path, r.path, b.path) like '%/' then coalesce({x}.flow_direction, '') = coalesce({y}.flow_direction, '') and coalesce({x}.flow_target, '') = coalesce({y}.flow_target, '') when coalesce(({x}.mode & 61440) = 40960, false) and coalesce(({y}.mode & 61440) = 40960, false) then coalesce({x}.target, '') = coalesce({y}.target, '') else {x}.digest is not distinct from {y}.digest end"
_E = lambda x, y: _MEQ.replace("{x}", x).replace("{y}", y)
_MERGE = f"""(select coalesce(l.mid, r.mid, b.mid) as manifest_id, coalesce(l.path, r.path, b.path) as path,
  case when b.path is null then case when r.path is null then 'take_local' when l.path is null then 'take_remote' when {_E("l", "r")} then 'take_local' else 'conflict' end
  when l.path is not null and r.path is not null then case when {_E("b", "l")} and {_E("b", "r")} then 'take_base' when {_E("b", "r")} then 'take_local' when {_E("b", "l")} then 'take_remote' when {_E("l", "r")} then 'take_local' else 'conflict' end
  when l.path is not null then case when {_E("b", "l")} then 'deleted' else 'conflict' end
  when r.path is not null then case when {_E("b", "r")} then 'deleted' else 'conflict' end else 'deleted' end as outcome,
  l.path is not null and r.path is not null as two, l.size as l_size, r.size as r_size, b.size as b_size, l.digest as l_digest, r.digest as r_digest, b.digest as b_digest, coalesce(r.ts, timestamptz '1970-01-01 00:00:00+00') > coalesce(l.ts, timestamptz '1970-01-01 00:00:00+00') as remote_later
  from (select p.manifest_id as mid, e.* from {{PAIRS}} p join {{LAST}} e on e.manifest_id = p.manifest_id where p.prev2 is not null) l
  full outer join (select p.manifest_id as mid, e.* from {{PAIRS}} p join {{LAST}} e on e.manifest_id = p.prev where p.prev2 is not null) r on l.mid = r.mid and l.path = r.path
  full outer join (select p.manifest_id as mid, e.* from {{PAIRS}} p join {{LAST}} e on e.manifest_id = p.prev2 where p.prev2 is not null) b on coalesce(l.mid, r.mid) = b.mid and coalesce(l.path, r.path) = b.path)"""


@query(f"select manifest_id, path, outcome from {_MERGE}")
def merge_outcomes(spark, folder):
    """Three consecutive listings as base, remote and local."""
    local, remote, base = _versions(spark, folder, 2)
    return versions.merge_outcomes(base, local, remote).select("manifest_id", "path", "outcome")


@query(f"select manifest_id, path from {_MERGE} where outcome = 'conflict'")
def merge_conflicts(spark, folder):
    local, remote, base = _versions(spark, folder, 2)
    return versions.merge(base, local, remote)[1].select("manifest_id", "path")


# What a merged row holds: the side an outcome takes; in a conflict the later one, or the one that is left.
_WON = "case outcome when 'take_base' then b_{c} when 'take_local' then l_{c} when 'take_remote' then r_{c} else case when not two then coalesce(l_{c}, r_{c}) when remote_later then r_{c} else l_{c} end end"


@query(
    f"select manifest_id, path, {_WON.replace('{c}', 'size')} as size, {_WON.replace('{c}', 'digest')} as digest from {_MERGE} where outcome <> 'deleted' union all"
    f" select manifest_id, case when path like '%/' then rtrim(path, '/') || '.conflict/' else path || '.conflict' end, case when remote_later then l_size else r_size end, case when remote_later then l_digest else r_digest end from {_MERGE} where outcome = 'conflict' and two"
    f" union all select manifest_id, path, null, null from (select distinct manifest_id, unnest(list_transform(range(1, len(regexp_extract_all(path, '[^/]+/')) + 1), lambda i: array_to_string(regexp_extract_all(path, '[^/]+/')[1:i], ''))) as path from {_MERGE} where outcome <> 'deleted') a where path is not null and not exists (select 1 from {_MERGE} m where m.outcome <> 'deleted' and m.manifest_id = a.manifest_id and m.path = a.path)",
    hexed=("digest",),
)
def merge_three_way(spark, folder):
    """The merged rows with what the winning side holds."""
    local, remote, base = _versions(spark, folder, 2)
    return versions.merge(base, local, remote)[0].select("manifest_id", "path", "size", "digest")


@query("select coalesce(n.mid, o.mid) as manifest_id, coalesce(n.path, o.path) as path, case when o.path is null then 'take_local' when n.path is null then 'take_remote' when " + _E("l", "r").replace("l.", "n.").replace("r.", "o.").replace("coalesce(n.path, o.path, b.path)", "n.path") + f" then 'take_local' else 'conflict' end as outcome {_BESIDE}")
def merge_union(spark, folder):
    local, remote = _versions(spark, folder)
    return versions.merge_outcomes(None, local, remote).select("manifest_id", "path", "outcome")


@query("select distinct manifest_id, p as path from (select manifest_id, unnest(list_transform(range(1, len(regexp_extract_all(path, '[^/]+/')) + 1), lambda i: array_to_string(regexp_extract_all(path, '[^/]+/')[1:i], ''))) as p from entries where path not like '%/')")
def implied_dirs(spark, folder):
    """Directories that the files' paths imply."""
    return M.implied_directories(M.filter_entries(_entries(spark, folder), ~F.col("path").endswith("/")))


@query("select e.manifest_id, 'archive/' || e.path as path from (select distinct manifest_id, path from entries) e union all select distinct manifest_id, 'archive/' from entries")
def under_prefix(spark, folder):
    e = _entries(spark, folder)
    missing = M.implied_directories(e)  # so that only the prefix is new
    moved = M.under_prefix(e, "archive").select("manifest_id", "path").distinct()
    return moved.join(missing.select("manifest_id", F.concat(F.lit("archive/"), "path").alias("path")), ["manifest_id", "path"], "left_anti")


# --- content across places


@query("""with a as (select distinct digest, path from entries where digest is not null and digest <> unhex(repeat('00', 64)) and manifest_id in (select manifest_id from manifests where mirrored)),
  b as (select digest, min(path) as path, count(*) as n from entries where digest is not null and digest <> unhex(repeat('00', 64)) and manifest_id not in (select manifest_id from manifests where mirrored) group by digest)
  select a.digest, min(a.path) as path_a, count(*) as paths_a, min(b.path) as path_b, min(b.n) as rows_b from a join b on a.digest = b.digest group by a.digest""", hexed=("digest",))
def leakage(spark, folder):
    """Content of mirrored manifests that others hold as well."""
    m = table(spark, folder, "manifests").where("mirrored").select("manifest_id").distinct()
    e = _entries(spark, folder).where(known_digest(F.col("digest"))).select("manifest_id", "digest", "path")
    a = e.join(m, "manifest_id", "left_semi").select("digest", "path").distinct().groupBy("digest").agg(F.min("path").alias("path_a"), F.count(F.lit(1)).alias("paths_a"))
    b = e.join(m, "manifest_id", "left_anti").groupBy("digest").agg(F.min("path").alias("path_b"), F.count(F.lit(1)).alias("rows_b"))
    return a.join(b, "digest")


@query("""with a as (select distinct digest from entries where digest is not null and digest <> unhex(repeat('00', 64)) and manifest_id in (select manifest_id from manifests where mirrored)),
  b as (select distinct digest from entries where digest is not null and digest <> unhex(repeat('00', 64)) and manifest_id not in (select manifest_id from manifests where mirrored))
  select count(*) as ids, count(*) filter (where digest in (select digest from b)) as shared, round(100.0 * count(*) filter (where digest in (select digest from b)) / count(*), 3) as percent from a""")
def leakage_share(spark, folder):
    """Share of the mirrored manifests' IDs that others hold as well."""
    m = table(spark, folder, "manifests").where("mirrored").select("manifest_id").distinct()
    e = _entries(spark, folder).where(known_digest(F.col("digest"))).select("manifest_id", "digest")
    sides = e.join(m.withColumn("_m", F.lit(1)), "manifest_id", "left").groupBy("digest").agg(F.count("_m").alias("a"), F.count_if(F.col("_m").isNull()).alias("b")).where("a > 0")
    return sides.agg(F.count(F.lit(1)).alias("ids"), F.count_if(F.col("b") > 0).alias("shared")).withColumn("percent", F.round(100.0 * F.col("shared") / F.col("ids"), 3))


@query("""select e.manifest_id, e.path, case when a.path is null then 'pending' when e.digest is null or e.digest is not distinct from a.digest then 'there' else 'corrupt' end as status
  from (select * from {LAST} where path not like '%/' and not coalesce((mode & 61440) = 16384, false) and manifest_id in (select manifest_id from manifests where mirrored)) e left join {MLAST} a on e.manifest_id = a.manifest_id and e.path = a.path""")
def expected_by_path(spark, folder):
    """Every file that the mirrored manifests expect: whether the second place has it, and the right content."""
    m = table(spark, folder, "manifests").where("mirrored").select("manifest_id").distinct()
    side = lambda t: latest(table(spark, folder, t).select("manifest_id", "path", "name", "mode", "ord", "digest").join(m, "manifest_id", "left_semi"))
    return trees.expected_status(M.files(side("entries")), side("mirror_entries"))


@query("select distinct digest from entries where digest is not null intersect select distinct digest from mirror_entries where digest is not null", hexed=("digest",))
def intersect_by_content(spark, folder):
    d = lambda t: table(spark, folder, t).where("digest is not null").select("digest")
    return d("entries").intersect(d("mirror_entries"))


@query("""select coalesce(e.manifest_id, a.manifest_id) as manifest_id, coalesce(e.path, a.path) as path, case when a.path is null then 'missing' when e.path is null then 'extra' when e.digest is not distinct from a.digest then 'ok' else 'corrupt' end as status, e.digest as expected, a.digest as actual
  from (select * from {LAST} where digest is not null and path not like '%/' and manifest_id in (select manifest_id from manifests where mirrored)) e full outer join (select * from {MLAST} where path not like '%/' and manifest_id in (select manifest_id from manifests where mirrored)) a on e.manifest_id = a.manifest_id and e.path = a.path""", hexed=("expected", "actual"))
def verify_report(spark, folder):
    """Files of the mirrored manifests against the second place."""
    m = table(spark, folder, "manifests").where("mirrored").select("manifest_id").distinct()
    side = lambda t: latest(table(spark, folder, t).where(~F.col("path").endswith("/")).select("manifest_id", "path", "ord", "digest").join(m, "manifest_id", "left_semi"))
    keyed = lambda d: d.select(F.struct("manifest_id", "path").alias("path"), "digest")
    r = trees.compare_content(keyed(side("entries")), keyed(side("mirror_entries")))
    return r.select("path.manifest_id", "path.path", "status", "expected", "actual")


@query("""with stored as (select distinct actual as digest from arrivals where actual is not null),
  t as (select * from {LAST} where manifest_id in (select manifest_id from manifests where mirrored) and (path like '%/' or digest is not null)), p as (select * from {MLAST} where manifest_id in (select manifest_id from manifests where mirrored)),
  j as (select coalesce(t.manifest_id, p.manifest_id) as manifest_id, coalesce(t.path, p.path) as path, t.path is not null as is_t, p.path is not null as is_p, t.digest as td, p.digest as pd, t.digest is not null and s.digest is null as lacking
    from t full outer join p on t.manifest_id = p.manifest_id and t.path = p.path left join stored s on s.digest = t.digest)
  select manifest_id, path, type, case type when 'mkdir' then 0 when 'create' then 1 when 'update' then 2 when 'remove' then 3 when 'rmdir' then 4 end as phase, length(regexp_replace(path, '[^/]', '', 'g'))::int as depth from (select *, case when is_t and path like '%/' then case when not is_p then 'mkdir' end when is_t and is_p and td is not distinct from pd then null
    when is_t and lacking then 'missing' when is_t then case when not is_p then 'create' else 'update' end when path like '%/' then 'rmdir' else 'remove' end as type from j) where type is not null""")
def reconcile_plan(spark, folder):
    """What would turn the second place into the mirrored manifests, with the arrived content as the store."""
    m = table(spark, folder, "manifests").where("mirrored").select("manifest_id").distinct()

    def side(t):
        rows = latest(table(spark, folder, t).select("manifest_id", "path", "ord", "digest").join(m, "manifest_id", "left_semi"))
        return rows.select(F.concat("manifest_id", F.lit(":"), "path").alias("path"), F.col("path").endswith("/").alias("is_dir"), "digest")

    target = side("entries").where("is_dir or digest is not null")
    stored = table(spark, folder, "arrivals").where("actual is not null").select(F.col("actual").alias("digest"))
    plan = trees.reconcile_plan(target, side("mirror_entries"), stored)
    return plan.select(F.substring_index("path", ":", 1).alias("manifest_id"), F.expr("substring(path, instr(path, ':') + 1)").alias("path"), "type", "phase", "depth")


@query("select distinct digest from entries where digest is not null and digest <> unhex(repeat('00', 64)) and digest not in (select actual from arrivals where actual is not null)", hexed=("digest",))
def store_missing(spark, folder):
    return trees.store_missing(_entries(spark, folder), table(spark, folder, "arrivals").where("actual is not null").select(F.col("actual").alias("digest")))


@query("""with w as (select manifest_id, digest, count(*) as n from entries where digest is not null and digest <> unhex(repeat('00', 64)) and not (coalesce(name like '%/', false) or coalesce((mode & 61440) = 16384, false)) group by all),
  s as (select distinct actual as digest from arrivals where actual is not null)
  select manifest_id, count(s.digest) as copied, coalesce(sum(case when s.digest is not null then n - 1 end), 0)::bigint as skipped, coalesce(sum(case when s.digest is null then n end), 0)::bigint as missing from w left join s on w.digest = s.digest group by manifest_id""")
def pool_counts(spark, folder):
    return trees.pool_counts(_entries(spark, folder), table(spark, folder, "arrivals").select(F.col("actual").alias("digest")))


@query("""select m.manifest_id, coalesce(max(m.n_entries), -1) as declared, count(distinct e.path) as listed, case when max(m.n_entries) is null then 'unknown' when max(m.n_entries) = count(distinct e.path) then 'complete' when max(m.n_entries) > count(distinct e.path) then 'short' else 'over' end as status
  from (select manifest_id, max(n_entries) as n_entries from manifests group by manifest_id) m left join entries e on m.manifest_id = e.manifest_id group by m.manifest_id""")
def expected_status(spark, folder):
    """Declared paths of each manifest against those listed."""
    m = table(spark, folder, "manifests").groupBy("manifest_id").agg(F.max("n_entries").alias("declared"))
    e = _entries(spark, folder).groupBy("manifest_id").agg(F.countDistinct("path").alias("listed"))
    j = m.join(e, "manifest_id", "left").withColumn("listed", F.coalesce("listed", F.lit(0)))
    status = F.when(F.col("declared").isNull(), "unknown").when(F.col("declared") == F.col("listed"), "complete").when(F.col("declared") > F.col("listed"), "short").otherwise("over")
    return j.select("manifest_id", F.coalesce("declared", F.lit(-1)).alias("declared"), "listed", status.alias("status"))


# --- rollups


@query()
def directory_ids(spark, folder):
    return rollup.directory_ids(_entries(spark, folder)).where(F.col("path").endswith("/")).select("manifest_id", "path", ident.id_text("digest").alias("id"))


# --- validation


_RULES = {
    "name_empty": ("error", "name is null or name = ''"), "name_slash": ("error", "name = '/'"), "name_dots": ("error", "regexp_replace(name, '/$', '') in ('.', '..')"),
    "name_separator": ("error", "name <> '/' and contains(regexp_replace(name, '/$', ''), '/')"), "name_backslash": ("error", "contains(name, chr(92))"), "name_nul": ("error", "contains(name, chr(0))"),
    "directory_no_slash": ("warning", "(mode & 61440) = 16384 and name not like '%/'"), "mode_type": ("error", "(mode & 61440) not in (0, 32768, 16384, 40960, 4096, 49152, 24576, 8192)"),
    "slash_not_directory": ("warning", "name like '%/' and (mode & 61440) <> 0 and (mode & 61440) <> 16384"), "size_negative": ("error", "size < 0"), "digest_length": ("error", "octet_length(digest) <> 64"),
}


@query("select manifest_id, ord + 1 as line, 'path_duplicate' as code from (select *, min(ord) over (partition by manifest_id, path) as first from entries where path is not null) where ord > first")
def duplicate_paths(spark, folder):
    return validate.duplicate_path_issues(_entries(spark, folder)).select("manifest_id", "line", "code")


@query("select manifest_id, ord + 1 as line, 'depth_jump' as code from (select manifest_id, ord, depth, lag(depth) over (partition by manifest_id order by ord) as before from (select manifest_id, ord, max(depth) as depth from entries where ord is not null and depth is not null group by all)) where depth > coalesce(before, -1) + 1")
def depth_jumps(spark, folder):
    return validate.depth_jump_issues(_entries(spark, folder)).select("manifest_id", "line", "code")


# --- fields


_BITS = "||".join(
    ["case mode & 61440 when 16384 then 'd' when 40960 then 'l' when 4096 then 'p' when 49152 then 's' when 24576 then 'b' when 8192 then 'c' else '-' end"]
    + [
        x
        for r, w, e, sp, m in ((256, 128, 64, 2048, "s"), (32, 16, 8, 1024, "s"), (4, 2, 1, 512, "t"))
        for x in (
            f"case when mode & {r} > 0 then 'r' else '-' end", f"case when mode & {w} > 0 then 'w' else '-' end",
            f"case when mode & {sp} > 0 then case when mode & {e} > 0 then '{m}' else '{m.upper()}' end when mode & {e} > 0 then 'x' else '-' end",
        )
    ]
)


@query(f"select distinct mode, case when coalesce(mode, 0) = 0 then '----------' else {_BITS} end as text from entries")
def format_mode(spark, folder):
    return _entries(spark, folder).select("mode").distinct().select("mode", fmt.format_mode(F.col("mode")).alias("text"))


def _read_back(spark, folder):
    """Rows of every manifest written as a whole text and decoded again.

    Directories that paths imply but a listing lacks are written too, as a text has no other way to place
    what is below them, and are left out again of what is read.
    """
    e = _entries(spark, folder).drop("parent", "is_dir", "pattern")  # no part of a line
    implied = written(M.implied_directories(e), "implied")
    place = os.path.join(shared_folder(spark).removeprefix("file://"), "stemma", f"texts-{uuid.uuid4().hex}")
    atexit.register(shutil.rmtree, place, ignore_errors=True)
    added = implied.select("manifest_id", "path", entry_name(F.col("path")).alias("name"), path_depth(F.col("path")).alias("depth"))
    codec.write_texts(e.unionByName(added, allowMissingColumns=True), place).agg(F.sum("lines")).first()
    return codec.decode(codec.read_texts(spark, "file://" + place)).join(implied, ["manifest_id", "path"], "left_anti")


@query("select manifest_id, path, coalesce(mode, 0) & 4095 as permissions, epoch(date_trunc('second', ts))::bigint as seconds, size, digest, target from {LAST}", hexed=("digest",))
def encode_roundtrip(spark, folder):
    """Every manifest written as a whole text and read back."""
    return _read_back(spark, folder).select(
        "manifest_id", "path", F.coalesce("mode", F.lit(0)).bitwiseAND(F.lit(0o7777)).alias("permissions"), F.unix_seconds("ts").alias("seconds"), "size", "digest", "target",
    )


@query(
    "select manifest_id, path, parent, name, depth, is_dir, case when (mode & 61440) = 32768 then nullif(mode & 4095, 0) else nullif(mode, 0) end as mode,"
    " epoch(date_trunc('second', ts))::bigint as seconds, size, digest, target from {LAST}",
    hexed=("digest",),
)
def manifest_roundtrip(spark, folder):
    """As encode_roundtrip, with the places of the rows and their full modes; a text has no regular-file bit."""
    return _read_back(spark, folder).select("manifest_id", "path", "parent", "name", "depth", "is_dir", "mode", F.unix_seconds("ts").alias("seconds"), "size", "digest", "target")
