"""Queries of the general data-comparison operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stemma.functions.base58 import ALPHABET, MAX_ID
from stemma.operators.copies import compare_mirrors, verify_report
from stemma.operators.lines import load_lines, rejected
from stemma.operators.snapshots import snapshot_changes
from stemma.operators.stamps import normalise_stamps
from stemma.runtime import table


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return compare_mirrors(table(spark, folder, "manifests"), table(spark, folder, "entries"), table(spark, folder, "mirror_entries"))


def p1_report(spark: SparkSession, folder: str) -> DataFrame:
    return verify_report(table(spark, folder, "manifests"), table(spark, folder, "entries"), table(spark, folder, "mirror_entries"))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return rejected(table(spark, folder, "raw_lines"))


def p3_load(spark: SparkSession, folder: str) -> DataFrame:
    """The valid lines; ts in seconds since 1970-01-01 UTC."""
    rows = load_lines(table(spark, folder, "raw_lines")).where("valid").drop("valid", "reasons")
    return rows.withColumn("ts", F.unix_seconds("ts"))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return normalise_stamps(table(spark, folder, "scan_stamps"), table(spark, folder, "sites"))


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    return snapshot_changes(table(spark, folder, "manifests"), table(spark, folder, "entries"))


QUERIES = {q.__name__: q for q in (p1_found, p1_report, p3_found, p3_load, p5_found, p6_found)}

_LAST = """
  select * from (select e.*, row_number() over (partition by e.manifest_id, e.path order by e.ord desc) rn from {t} e
                 where e.path is not null) where rn = 1
"""
_ROW = """
  select manifest_id, path, case when (mode & 61440) = 32768 then mode & 4095 else mode end as mode,
         date_trunc('second', ts) as ts, size, digest, target
  from ({last}) where manifest_id in (select manifest_id from manifests where mirrored)
"""

SQL = {
    "p1_found": f"""
with l as ({_ROW.format(last=_LAST.format(t="entries"))}), r as ({_ROW.format(last=_LAST.format(t="mirror_entries"))}),
b as (select coalesce(l.manifest_id, r.manifest_id) as manifest_id, coalesce(l.path, r.path) as path,
  l.path is null as extra, r.path is null as missing,
  l.mode is distinct from r.mode as d_mode, l.ts is distinct from r.ts as d_ts, l.size is distinct from r.size as d_size,
  l.digest is distinct from r.digest as d_digest, l.target is distinct from r.target as d_target
  from l full outer join r on l.manifest_id = r.manifest_id and l.path = r.path)
select manifest_id, path, 'missing' as difference from b where missing
union all select manifest_id, path, 'extra' from b where extra
union all select manifest_id, path, 'mode' from b where not missing and not extra and d_mode
union all select manifest_id, path, 'ts' from b where not missing and not extra and d_ts
union all select manifest_id, path, 'size' from b where not missing and not extra and d_size
union all select manifest_id, path, 'digest' from b where not missing and not extra and d_digest
union all select manifest_id, path, 'target' from b where not missing and not extra and d_target
""",
    "p6_found": f"""
with m as (select *, lag(manifest_id) over (partition by tree order by seq) as prev
           from (select manifest_id, min(tree) as tree, min(seq) as seq from manifests group by manifest_id)),
e as (select manifest_id, path, date_trunc('second', ts) as ts, size, digest from ({_LAST.format(t="entries")})),
n as (select m.manifest_id, e.path, e.ts, e.size, e.digest from m join e on e.manifest_id = m.manifest_id where m.prev is not null),
p as (select m.manifest_id, e.path, e.ts, e.size, e.digest from m join e on e.manifest_id = m.prev)
select coalesce(n.manifest_id, p.manifest_id) as manifest_id, coalesce(n.path, p.path) as path,
  case when p.path is null then 'added' when n.path is null then 'removed' else 'modified' end as status
from n full outer join p on n.manifest_id = p.manifest_id and n.path = p.path
where p.path is null or n.path is null or n.ts is distinct from p.ts or n.size is distinct from p.size or n.digest is distinct from p.digest
""",
}
SQL["p1_report"] = f"""
select manifest_id, count(*) filter (where difference = 'missing') as missing, count(*) filter (where difference = 'extra') as extra,
  count(*) filter (where difference not in ('missing', 'extra')) as field_differences,
  count(distinct path) filter (where difference not in ('missing', 'extra')) as corrupt
from ({SQL["p1_found"]}) group by manifest_id
"""

# The line format in plain SQL: escaped pairs are marked with chr(1) (an escaped blank becomes chr(1), chr(2)),
# so that fields are what stands between the blanks left.
_B58 = f"[{ALPHABET}]"
_ID_OK = f"(regexp_full_match({{x}}, 'c4{_B58}{{{{88}}}}') and {{x}} <= '{MAX_ID}')"
_TS_SHAPE = "[0-9]{4}-[0-9]{2}-[0-9]{2}T([01][0-9]|2[0-3]):[0-5][0-9]:[0-5][0-9](Z|[+-]([01][0-9]|2[0-3]):[0-5][0-9])"
SQL["p3_found"] = f"""
with r as (select line_id, ltrim(line, ' ') as rest from raw_lines where line is not null),
c as (select * from r where rest <> '' and not (regexp_full_match(rest, '(c4{_B58}{{88}})+')
  and len(list_filter(range(0, length(rest) // 90), lambda i: substr(rest, i * 90 + 1, 90) > '{MAX_ID}')) = 0)),
m as (select line_id, string_split(replace(regexp_replace(rest, '\\\\(.)', chr(1) || '\\1', 'gs'), chr(1) || ' ', chr(1) || chr(2)), ' ') as f from c),
p as (select line_id, f, len(f) = 5 or (len(f) = 7 and f[5] = '->') as ok, f[len(f)] as id, case when len(f) = 7 then [f[4], f[6]] else [f[4]] end as names from m)
select line_id, 'columns' as reason from p where not ok
union all select line_id, 'quoting' from p where ok and len(list_filter(names, lambda n: not regexp_full_match(n, '([^"\\\\' || chr(1) || ']|' || chr(1) || '[' || chr(2) || '"\\[\\]\\\\0tnr])+', 's'))) > 0
union all select line_id, 'mode' from p where ok and not regexp_full_match(f[1], '-|[-dlbcps][-rwxstST]{{9}}')
union all select line_id, 'ts' from p where ok and f[2] not in ('-', '0') and not (regexp_full_match(f[2], '{_TS_SHAPE}') and substr(f[2], 1, 4) <> '0000' and try_cast(substr(f[2], 1, 10) as date) is not null)
union all select line_id, 'size' from p where ok and f[3] <> '-' and not (regexp_full_match(f[3], '[0-9]+|[0-9]{{1,3}}(,[0-9]{{3}})+') and coalesce(try_cast(replace(f[3], ',', '') as hugeint) < 9223372036854775808, false))
union all select line_id, 'c4id' from p where ok and id <> '-' and not {_ID_OK.format(x="id")}
"""

_RAW = "{x}"
for _mark, _char in (("'0'", "chr(0)"), ("'t'", "chr(9)"), ("'n'", "chr(10)"), ("'r'", "chr(13)"), ("chr(2)", "' '")):
    _RAW = f"replace({_RAW}, chr(1) || {_mark}, {_char})"
_RAW = f"replace({_RAW}, chr(1), '')"  # the other escaped characters stand for themselves
_MODE_SQL = "+".join(
    f"case when substr(f[1], {i + 2}, 1) = '{'rwx'[i % 3]}'" + (f" or substr(f[1], {i + 2}, 1) in ('s', 't')" if i % 3 == 2 else "") + f" then {0o400 >> i} else 0 end"
    + (f" + case when lower(substr(f[1], {i + 2}, 1)) = '{'t' if i == 8 else 's'}' then {0o4000 >> (i // 3)} else 0 end" if i % 3 == 2 else "")
    for i in range(9)
)
_AT = "epoch(strptime(substr(f[2], 1, 19), '%Y-%m-%dT%H:%M:%S'))::bigint"
SQL["p3_load"] = f"""
with bad as ({SQL["p3_found"]}), {SQL["p3_found"].split("select line_id, 'columns'")[0].strip().removeprefix("with ")}
select line_id, case when f[1] in ('-', '----------') then null else case f[1][1:1] when 'd' then 16384 when 'l' then 40960 when 'b' then 24576 when 'c' then 8192 when 'p' then 4096 when 's' then 49152 else 0 end + {_MODE_SQL} end as mode,
  case when f[2] in ('-', '0') then null when f[2] like '%Z' then {_AT} else {_AT} - (case when substr(f[2], 20, 1) = '-' then -1 else 1 end) * (substr(f[2], 21, 2)::int * 3600 + substr(f[2], 24, 2)::int * 60) end as ts,
  case when f[3] = '-' then null else replace(f[3], ',', '')::bigint end as size, {_RAW.format(x="f[4]")} as name, case when len(f) = 7 then {_RAW.format(x="f[6]")} end as target, nullif(id, '-') as c4id
from p where line_id not in (select line_id from bad)
"""

# Stamps in plain SQL: one pattern a notation, with the same named parts; then one conversion for all.
_CLOCK = "([0-9]{1,2}):([0-9]{2})(?::([0-9]{2})(?:[.,]([0-9]+))?)?"
_ZONE = "( ?[+-][0-9]{2}:?[0-9]{2}| ?[A-Za-z]| [A-Za-z]{2,5}| ?\\[[A-Za-z]{2,5}\\]| [A-Za-z]+(?:[/_+-][A-Za-z0-9]+)+| ?\\[[A-Za-z]+(?:[/_+-][A-Za-z0-9]+)+\\])?"
_STAMPS = {  # pattern: its parts in order
    **{f"([0-9]{{4}}){sep}([0-9]{{2}}){sep}([0-9]{{2}})(?:[Tt ]{_CLOCK}{_ZONE})?": "y mo d h mi s f z" for sep in ("-", "/", "[.]")},
    f"([0-9]{{1,2}})/([0-9]{{1,2}})/([0-9]{{4}})(?: {_CLOCK}(?: ?([AaPp][Mm]))?)?": "mo d y h mi s f ap",
    f"([0-9]{{1,2}})[.]([0-9]{{1,2}})[.]([0-9]{{4}})(?: {_CLOCK}{_ZONE})?": "d mo y h mi s f z",
    f"(?:[A-Za-z]+, ?)?([0-9]{{1,2}})[ -]([A-Za-z]{{3,9}})[ -]([0-9]{{4}})(?: {_CLOCK}{_ZONE})?": "d mo y h mi s f z",
    f"([A-Za-z]{{3,9}}) {{1,2}}([0-9]{{1,2}}),? {_CLOCK} ([0-9]{{4}}){_ZONE}": "mo d h mi s f y z",
    f"[A-Za-z]{{3}} ([A-Za-z]{{3,9}}) {{1,2}}([0-9]{{1,2}}) {_CLOCK}{_ZONE} ([0-9]{{4}})": "mo d h mi s f z y",
    f"([A-Za-z]{{3,9}}) {{1,2}}([0-9]{{1,2}}), ([0-9]{{4}})(?: {_CLOCK}{_ZONE})?": "mo d y h mi s f z",
    f"([0-9]{{4}})([0-9]{{2}})([0-9]{{2}})(?:[Tt ]([0-9]{{2}})([0-9]{{2}})(?:([0-9]{{2}})(?:[.,]([0-9]+))?)?{_ZONE})?": "y mo d h mi s f z",
    "([0-9]{4})([0-9]{2})([0-9]{2})([0-9]{2})([0-9]{2})(?:([0-9]{2})([0-9]*))?": "y mo d h mi s f",
}
_PARTS = ("y", "mo", "d", "h", "mi", "s", "f", "z", "ap")


def _notation(pattern: str, parts: str) -> str:
    given = {k: i + 1 for i, k in enumerate(parts.split())}
    cols = ", ".join(f"regexp_extract(t, '^(?:{pattern})$', {given[k]}) as {k}" if k in given else f"'' as {k}" for k in _PARTS)
    return f"select stamp_id, tz, {cols} from r where regexp_full_match(t, '{pattern}') and not regexp_full_match(t, '[0-9]{{10}}|[0-9]{{13}}|[0-9]{{16}}')"


_MONTHS = "['jan','feb','mar','apr','may','jun','jul','aug','sep','oct','nov','dec']"
SQL["p5_found"] = f"""
with r as (select s.stamp_id, regexp_replace(s.stamp, '^\\s+|\\s+$', '', 'g') as t, z.tz from scan_stamps s left join (select site_id, min(tz) as tz from sites group by site_id) z on s.site_id = z.site_id where s.stamp is not null),
n as ({" union all ".join(_notation(p, k) for p, k in _STAMPS.items())}),
a as (select *, case when regexp_matches(mo, '^[0-9]') then mo::int else list_position({_MONTHS}, lower(mo[1:3])) end as m, trim(replace(replace(z, '[', ' '), ']', ' ')) as zone,
  case lower(ap) when 'am' then h::int % 12 when 'pm' then h::int % 12 + 12 else try_cast(nullif(h, '') as int) end as hour from n),
b as (select *, try_cast(y || '-' || lpad(m::varchar, 2, '0') || '-' || lpad(d, 2, '0') as date) as day, coalesce(hour, 0) * 3600 + coalesce(try_cast(nullif(mi, '') as int), 0) * 60 + coalesce(try_cast(nullif(s, '') as int), 0) as sec,
  rpad(f[1:6], 6, '0')::bigint as us from a where coalesce(hour, 0) < 24 and coalesce(try_cast(nullif(mi, '') as int), 0) < 60 and coalesce(try_cast(nullif(s, '') as int), 0) < 60 and (ap = '' or h::int between 1 and 12)),
c as (select *, day + to_seconds(sec) as loc, case when regexp_matches(zone, '^[+-]') then zone[1:1] || lpad(zone[2:3], 2, '0') || ':' || zone[-2:] end as off,
  case when zone in ('UTC', 'GMT', 'Z', 'z') then 'UTC' when contains(zone, '/') then zone when zone = '' or regexp_full_match(zone, '[A-Za-z]{{2,5}}') then tz end as name from b where day is not null and y <> '0000'),
d as (select stamp_id, us, zone, loc, name, off, case when off is not null then epoch_us(loc) // 1000000 - (case when off[1:1] = '-' then -1 else 1 end) * (off[2:3]::int * 3600 + off[5:6]::int * 60)
  when name = 'UTC' then epoch_us(loc) // 1000000 else epoch_us(timezone(name, loc)) // 1000000 end as late from c),
e as (select *, case when off is null and name <> 'UTC' then list_filter([3600, 1800], lambda k: timezone(name, to_timestamp(late - k)) = loc)[1] end as back from d where late is not null),
p as (select stamp_id, us, case when back is null then late
  -- letters that name only the second reading: standard time after daylight time
  when regexp_full_match(zone, 'EST|CST|MST|PST|CET|EET|WET|AEST|NZST') then late else late - back end as sec from e)
select stamp_id, sec * 1000000 + us as utc_us from p where sec * 1000000 + us <> 0
union all select stamp_id, u from (select stamp_id, t[1:length(n)]::bigint * case length(n) when 10 then 1000000 when 13 then 1000 else 1 end + case when length(n) = 10 then rpad(f[1:6], 6, '0')::bigint else 0 end as u
  from (select stamp_id, t, regexp_extract(t, '^([0-9]+)', 1) as n, regexp_extract(t, '[.,]([0-9]+)$', 1) as f from r where regexp_full_match(t, '[0-9]{{10}}(?:[.,][0-9]+)?|[0-9]{{13}}|[0-9]{{16}}'))) where u <> 0
"""
