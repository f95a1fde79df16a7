"""Queries of the text forms: names, fields, lines, whole texts and their messages.

Each returns the text itself, so that the SQL beside it spells out the format a second time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stemma.functions import fmt, ident, names
from stemma.functions.base58 import ALPHABET, MAX_ID
from stemma.operators import manifest as M
from stemma.operators import rollup, validate, versions
from stemma.plans.manifests import _BESIDE, _BITS, _IDENT, _KEPT, _PARTS, _chain, _entries, _versions, query
from stemma.plans.problems import _MODE_SQL
from stemma.runtime import table, written
from stemma.schema import entry_name, latest, path_depth
from stemma.sources import codec

# --- the formats in SQL

_HID = r"(?:[^\p{L}\p{M}\p{N}\p{P}\p{S}\p{Zs}\t\n\r\x00]|¤)"
_NIBBLE = "(strpos('0123456789ABCDEF', {h}) - 1)"
_SIGNS = "'¤' || array_to_string(list_transform(regexp_extract_all(hex(encode(p)), '..'), lambda h: chr((10240 + " + _NIBBLE.format(h="h[1:1]") + " * 16 + " + _NIBBLE.format(h="h[2:2]") + ")::int)), '') || '¤'"
_CHAR = "case p when chr(92) then chr(92) || chr(92) when chr(0) then chr(92) || '0' when chr(9) then chr(92) || 't' when chr(10) then chr(92) || 'n' when chr(13) then chr(92) || 'r' else p end"


def safe_sql(x: str) -> str:
    return f"array_to_string(list_transform(regexp_extract_all({x}, '(?s){_HID}+|.'), lambda p: case when regexp_full_match(p, '{_HID}+') then {_SIGNS} else {_CHAR} end), '')"


def escaped_sql(x: str, marks: str = r'([ "\[\]])') -> str:
    return rf"regexp_replace({safe_sql(x)}, '{marks}', '\\\1', 'g')"


def name_sql(name: str) -> str:
    """Name field of a name that is no sequence."""
    return f"({escaped_sql(f'regexp_replace({name}, {chr(39)}/${chr(39)}, {chr(39)}{chr(39)})')} || case when {name} like '%/' then '/' else '' end)"


_SPAN = r"regexp_extract(name, '\[[0-9,:\-]+\]')"
_BEFORE, _AFTER = f"substr(name, 1, strpos(name, {_SPAN}) - 1)", f"substr(name, strpos(name, {_SPAN}) + length({_SPAN}))"
_FIELD = f"case when not coalesce(is_sequence, false) then {name_sql('name')} when {_SPAN} = '' then name else {escaped_sql(_BEFORE)} || {_SPAN} || {escaped_sql(_AFTER)} end"


# IDs of distinct digests: sixteen limbs divided by 58**5, eighteen times.
_D5 = " || ".join(f"'{ALPHABET}'[(z.r // {58**i}) % 58 + 1]" for i in (4, 3, 2, 1, 0))
IDS = f"""
_s as (select digest, 0 as k, '' as t, list_transform(range(16), lambda i: ('0x' || substr(hex(digest), i * 8 + 1, 8))::bigint) as l from (select distinct digest from entries where digest is not null)
  union all select digest, k + 1, ({_D5}) || t, z.q from (select digest, k, t, list_reduce(l, lambda a, x: {{'r': (a.r * 4294967296 + x) % 656356768, 'q': list_append(a.q, (a.r * 4294967296 + x) // 656356768)}}, {{'r': 0::bigint, 'q': []::bigint[]}}) as z from _s where k < 18)),
ids as (select digest, 'c4' || right(t, 88) as id from _s where k = 18)"""
_NIL = "unhex(repeat('00', 64))"
_TIME = "make_timestamp(epoch_us({t}))"
_MODE = f"case when coalesce(mode, 0) = 0 then '-' else {_BITS} end"
_TS = "case when ts is null or epoch(date_trunc('second', ts))::bigint = 0 then '-' else strftime(" + _TIME.format(t="ts") + ", '%Y-%m-%dT%H:%M:%SZ') end"
_SIZE = "case when size is null or size < 0 then '-' else size::varchar end"
_LINK = (
    "case when coalesce(target, '') <> '' then ' -> ' || " + escaped_sql("target", r'([ "])') + " when coalesce(hard_link, 0) < 0 then ' ->' when coalesce(hard_link, 0) > 0 then ' ->' || hard_link"
    " when coalesce(flow_direction, '') <> '' then ' ' || flow_direction || ' ' || coalesce(flow_target, '') else '' end"
)
BARE_LINE = f"{_MODE} || ' ' || {_TS} || ' ' || {_SIZE} || ' ' || {_FIELD} || {_LINK}"


# --- names and fields


@query(f"with recursive {IDS} select lower(hex(digest)) as digest, id from ids")
def id_texts(spark, folder):
    """Every digest as its ID."""
    d = _entries(spark, folder).where("digest is not null").select("digest").distinct()
    return d.select(ident.hex_text(F.col("digest")).alias("digest"), ident.id_text("digest").alias("id"))


@query("select doc_id, 90 as length, true as same from documents")
def content_ids(spark, folder):
    """ID of every post's text, read back and compared with the digest that the workers' own library gives."""
    import hashlib

    @F.pandas_udf("binary")
    def hashed(text):
        return text.map(lambda t: hashlib.sha512((t or "").encode()).digest())

    d = table(spark, folder, "documents").select("doc_id", ident.id_text(ident.digest_of(F.coalesce("text", F.lit("")))).alias("id"), hashed("text").alias("_own"))
    return d.select("doc_id", F.length("id").alias("length"), ident.id_digest("id").eqNullSafe(F.col("_own")).alias("same"))


_PLANTED = "\t\x01\x02¤\n[\\\x7f"
_PLANTED_SQL = "chr(9) || chr(1) || chr(2) || '¤' || chr(10) || '[' || chr(92) || chr(127)"


def _planted(spark, folder) -> DataFrame:
    """Names as they are and with characters that can't be printed in their middle."""
    n = _entries(spark, folder).select("name").distinct().where("name is not null")
    return n.select(F.explode(F.array("name", F.concat(F.lit("a"), F.lit(_PLANTED), "name"))).alias("name"))


_NAMES = f"(select unnest([name, 'a' || {_PLANTED_SQL} || name]) as name from (select distinct name from entries where name is not null))"


@query(f"select name, {safe_sql('name')} as safe from {_NAMES}")
def safe_names(spark, folder):
    return _planted(spark, folder).select("name", fmt.safe_name(F.col("name")).alias("safe"))


@query(f"select {safe_sql('name')} as safe, name as raw from {_NAMES}")
def unsafe_names(spark, folder):
    """Printable names read back."""
    return _planted(spark, folder).select(fmt.safe_name(F.col("name")).alias("safe")).select("safe", names.unsafe_name("safe").alias("raw"))


@query(f"select name, {name_sql('name')} as field from {_NAMES}")
def name_fields(spark, folder):
    return _planted(spark, folder).select("name", fmt.format_name(F.col("name"), F.lit(False)).alias("field"))


@query(f"select name, {escaped_sql('name')} || '[0001-0010,20]' || {escaped_sql(chr(39) + '. x[' + chr(39) + ' || name')} as field, true as again from {_NAMES} where name not like '%/' and not regexp_matches(name, '\\[[0-9,:\\-]+\\]')")
def sequence_names(spark, folder):
    """Names of frame sequences: the first range stays, what is around it is escaped; read back as one."""
    n = _planted(spark, folder).where(~F.col("name").endswith("/") & ~F.col("name").rlike(r"\[[0-9,:\-]+\]"))
    field = fmt.format_name(F.concat("name", F.lit("[0001-0010,20]. x["), "name"), F.lit(True))
    return n.select("name", field.alias("field")).withColumn("again", fmt.is_sequence(F.col("field")))


@query("select size, case when size < 0 then '-' else format('{:,}', size) end as commas, case when size < 0 then '-' else size::varchar end as plain from (select distinct unnest([size, size * 1000003, -size]) as size from entries where size is not null)")
def size_fields(spark, folder):
    s = F.col("size")
    d = _entries(spark, folder).where("size is not null").select(F.explode(F.array(s, s * 1_000_003, -s)).alias("size")).distinct()
    return d.select("size", fmt.comma_size(s).alias("commas"), fmt.format_size(s).alias("plain"))


_PRETTY_TS = "strftime({t}, '%b ') || lpad(day({t})::varchar, 2, ' ') || strftime({t}, ' %H:%M:%S %Y') || ' UTC'".replace("{t}", _TIME.replace("{t}", "ts"))


@query(f"select epoch_us(ts) as us, {_TS} as canonical, {_PRETTY_TS} as pretty, case when epoch(date_trunc('second', ts))::bigint <> 0 then epoch(date_trunc('second', ts))::bigint end as parsed, epoch(date_trunc('second', ts))::bigint as parsed_pretty from (select distinct ts from entries where ts is not null)")
def time_fields(spark, folder):
    """Times in both forms, and both read back."""
    t = F.col("ts")
    d = _entries(spark, folder).where("ts is not null").select("ts").distinct()
    d = d.select(F.unix_micros(t).alias("us"), fmt.format_ts(t).alias("canonical"), fmt.format_pretty_ts(t).alias("pretty"))
    return d.select("*", F.unix_seconds(fmt.parse_ts(F.col("canonical"))).alias("parsed"), F.unix_seconds(fmt.parse_ts(F.col("pretty"))).alias("parsed_pretty"))


_FIRST_WORD, _LAST_WORD = "regexp_extract(line, '^ *([^ ]*)', 1)", "regexp_extract(line, '([^ ]*)$', 1)"
_VALID_MODE = "regexp_full_match(text, '[-dlpsbc](?:[r-][w-][xsS-]){2}[r-][w-][xtT-]')"


@query(
    f"select text, case when {_VALID_MODE} and text <> '----------' then case text[1:1] when 'd' then 16384 when 'l' then 40960 when 'b' then 24576 when 'c' then 8192 when 'p' then 4096 when 's' then 49152 else 0 end + {_MODE_SQL.replace('f[1]', 'text')} end as mode"
    f" from (select distinct {_FIRST_WORD} as text from raw_lines where line is not null)"
)
def parsed_modes(spark, folder):
    """The mode of each line as a number, null where it is none."""
    text = table(spark, folder, "raw_lines").where("line is not null").select(F.regexp_extract("line", "^ *([^ ]*)", 1).alias("text")).distinct()
    return text.select("text", fmt.parse_mode(F.col("text")).alias("mode"))


@query("select manifest_id, path, row_number() over (partition by manifest_id order by path) as rank from {LAST}")
def path_order(spark, folder):
    """Place of each path in code-point order."""
    return M.numbered(latest(_entries(spark, folder).select("manifest_id", "path", "ord")).select("manifest_id", "path"), F.col("path"), "manifest_id")


_AT = [(1, "-dlpsbc", "file type")] + [(2 + 3 * w + i, letters, label) for w in range(3) for i, (letters, label) in enumerate((("r-", "read flag"), ("w-", "write flag"), ("xtT-" if w == 2 else "xsS-", "execute flag")))]


@query(
    "select distinct text, case when text = '-' then '' when length(text) <> 10 then 'the length isn''t 10' else array_to_string(list_filter(["
    + ", ".join(f"case when strpos('{letters}', text[{i}:{i}]) = 0 then 'position {i}: no {label}' end" for i, letters, label in _AT)
    + f"], lambda m: m is not null), '; ') end as messages from (select {_FIRST_WORD} as text from raw_lines where line is not null)"
)
def mode_messages(spark, folder):
    """What is wrong with the mode of each line."""
    text = table(spark, folder, "raw_lines").where("line is not null").select(F.regexp_extract("line", "^ *([^ ]*)", 1).alias("text")).distinct()
    return text.select("text", F.array_join(validate.mode_string_messages(F.col("text")), "; ").alias("messages"))


@query(
    "select distinct text, case when text = '-' then '' else array_to_string(list_filter([case when length(text) <> 90 then 'the length isn''t 90' end, case when not starts_with(text, 'c4') then 'it doesn''t start with c4' end,"
    f" case when not regexp_full_match(substr(text, 3), '[{ALPHABET}]*', 's') then 'it holds a character that is no base58 digit' end, case when length(text) = 90 and starts_with(text, 'c4') and text > '{MAX_ID}' then 'its value is above 512 bits' end],"
    f" lambda m: m is not null), '; ') end as messages from (select {_LAST_WORD} as text from raw_lines where line is not null)"
)
def id_messages(spark, folder):
    """What is wrong with the ID of each line."""
    text = table(spark, folder, "raw_lines").where("line is not null").select(F.regexp_extract("line", r"([^ ]*)\z", 1).alias("text")).distinct()
    return text.select("text", F.array_join(validate.id_string_messages(F.col("text")), "; ").alias("messages"))


# --- lines and texts


@query(f"with recursive {IDS} select manifest_id, path, repeat('  ', depth) || {BARE_LINE} || ' ' || coalesce(case when e.digest <> {_NIL} then ids.id end, '-') as line from {{LAST}} e left join ids on ids.digest = e.digest")
def entry_lines(spark, folder):
    """Every entry as its indented line."""
    return codec.entry_lines(_entries(spark, folder)).select("manifest_id", "path", "line")


@query(
    f"with recursive {IDS}, a as (select manifest_id, path, digest, repeat('  ', depth) || case when coalesce(mode, 0) = 0 then '----------' else {_BITS} end || ' ' || case when ts is null or epoch(date_trunc('second', ts))::bigint = 0 then rpad('-', 25, ' ') else {_PRETTY_TS} end || ' ' as a,"
    f" case when size is null or size < 0 then '-' else format('{{:,}}', size) end as s, ' ' || {_FIELD} || {_LINK} as b from {{LAST}}),"
    " w as (select manifest_id, max(length(s)) as w, max(length(a) + length(b)) as l from a group by manifest_id), b as (select a.manifest_id, path, digest, a.a || lpad(s, w::int, ' ') || a.b as body, greatest(80, ceil((l + w + 10) / 10.0) * 10)::int as col from a join w using (manifest_id))"
    f" select manifest_id, path, body || repeat(' ', greatest(10, col - length(body))::int) || coalesce(case when b.digest <> {_NIL} then ids.id end, '-') as line from b left join ids on ids.digest = b.digest"
)
def pretty_lines(spark, folder):
    """Every entry as its line for reading."""
    return codec.pretty_lines(_entries(spark, folder)).select("manifest_id", "path", "line")


@query(f"with recursive {IDS} select manifest_id, path, {BARE_LINE} || ' ' || coalesce(case when e.digest <> {_NIL} then ids.id end, '-') as line from {{LAST}} e left join ids on ids.digest = e.digest")
def canonical_lines(spark, folder):
    """Every line read by the text codec, and written again by its own writer of single texts."""
    lines = codec.entry_lines(_entries(spark, folder)).select("manifest_id", "path", F.ltrim("line").alias("line"))

    @F.pandas_udf("string")
    def again(line):
        return line.map(lambda x: codec.canonicalized(x.encode() + b"\n").decode().rstrip("\n"))

    return lines.select("manifest_id", "path", again("line").alias("line"))


@query("with a as (select manifest_id, path from {LAST} union select distinct manifest_id, unnest(list_transform(range(1, len(regexp_extract_all(path, '[^/]+/')) + 1), lambda i: array_to_string(regexp_extract_all(path, '[^/]+/')[1:i], ''))) from entries) select manifest_id, path, nullif(regexp_extract(path, '^(.*/)?[^/]+/?$', 1), '') as parent from a where path is not null")
def rebuilt_paths(spark, folder):
    """Paths and parents rebuilt from the order, depth and name of the rows of whole trees."""
    e = M.with_implied(latest(_entries(spark, folder).select("manifest_id", "path", "ord")).select("manifest_id", "path"))
    e = M.numbered(e.select("manifest_id", "path").where("manifest_id is not null"), fmt.tree_key(F.col("path")), "manifest_id")
    rows = e.select("manifest_id", F.col("rank").alias("ord"), entry_name(F.col("path")).alias("name"), path_depth(F.col("path")).alias("depth"))
    return M.with_paths(rows).select("manifest_id", "path", "parent")


@query("select manifest_id, path, section_idx, size, digest from (select p.manifest_id, e.path, 0 as section_idx, e.size, e.digest from {PAIRS} p join {LAST} e on e.manifest_id = p.prev union all select coalesce(n.mid, o.mid), coalesce(n.path, o.path), 1, case when n.path is null then o.size else n.size end, case when n.path is null then o.digest else n.digest end " + _BESIDE + f" where n.path is null and not ({_KEPT.replace('{o}', 'o')}) or o.path is null or n.path is not null and not ({_IDENT}))", hexed=("digest",))
def decoded_chains(spark, folder):
    """A listing's text and the text of its patch to the next one, as one text of two sections, decoded.

    Rows that only place others are left out again: directories that paths imply, and context of the patch.
    """
    new, old = _versions(spark, folder)
    implied = written(M.implied_directories(old).withColumn("section_idx", F.lit(0)), "implied")
    base = codec.entry_lines(M.with_implied(old.drop("parent", "is_dir", "pattern").withColumn("section_idx", F.lit(0)))).select("manifest_id", F.lit(0).alias("section_idx"), "key", "line")
    patch = versions.patch_lines(old, new).select("manifest_id", F.lit(1).alias("section_idx"), "key", "line")
    lines = base.unionByName(patch).repartition("manifest_id").sortWithinPartitions("manifest_id", "section_idx", F.col("key").asc_nulls_first())
    return _decoded(spark, lines).where(~versions.is_context()).join(implied, ["manifest_id", "path", "section_idx"], "left_anti").select("manifest_id", "path", "section_idx", "size", "digest")


def _decoded(spark, lines: DataFrame) -> DataFrame:
    from stemma.plans.places import work_folder

    place = work_folder(spark, "texts")
    codec.write_files(lines, place, ".c4m").agg(F.sum("lines")).first()
    return codec.decode(codec.read_texts(spark, "file://" + place))


# --- summaries and validation

_FILE = "not (coalesce(name like '%/', false) or coalesce((mode & 61440) = 16384, false))"
_HUMAN = "case when b < 1024 then b || ' B' when b < 1048576 then printf('%.1f KB', b / 1024.0) when b < 1073741824 then printf('%.1f MB', b / 1048576.0) when b < 1099511627776 then printf('%.1f GB', b / 1073741824.0) else printf('%.1f TB', b / 1099511627776.0) end"


@query(f"select manifest_id, format('{{:,}}', f) || ' files, ' || format('{{:,}}', d) || ' directories, ' || {_HUMAN} || ', ' || format('{{:,}}', u) || ' unique IDs' as text from (select manifest_id, count(*) filter (where {_FILE}) as f, count(*) filter (where not {_FILE}) as d, coalesce(sum(size) filter (where {_FILE}), 0)::bigint as b, count(distinct digest) filter (where {_FILE} and digest <> {_NIL}) as u from entries group by manifest_id)")
def summary_text(spark, folder):
    return M.summary_text(_entries(spark, folder))


# A fault each: column, its value as Spark and as SQL expression, severity, code and message.
_FAULTS = (
    ("name", "''", "error", "name_empty", "the name is empty"), ("name", "'/'", "error", "name_slash", "the name is a slash"), ("name", "'..'", "error", "name_dots", "the name is . or .."),
    ("name", "'a/b'", "error", "name_separator", "the name holds a path separator"), ("name", "concat('a', chr(92), 'b')", "error", "name_backslash", "the name holds a backslash"), ("name", "concat('a', chr(0), 'b')", "error", "name_nul", "the name holds a NUL"),
    ("mode", "49407", None, None, None), ("mode", "61440", "error", "mode_type", "the mode has no known file type"), ("size", "-1", "error", "size_negative", "the size is negative"), ("digest", "unhex('00ff')", "error", "digest_length", "the ID hasn't 64 bytes"),
    ("mode", "16877", "warning", "directory_no_slash", "a directory's name ends without a slash"), ("name", "'d/'", "warning", "slash_not_directory", "the name ends in a slash but the mode is no directory's"),
)


def _rules_sql(rows: str) -> str:
    from stemma.plans.manifests import _RULES

    messages = {c: m for _, _, _, c, m in _FAULTS if c}
    return " union all ".join(f"select manifest_id, fault, '{s}' as severity, '{c}' as code, '{messages[c].replace(chr(39), chr(39) * 2)}' as message from {rows} where {w}" for c, (s, w) in _RULES.items())


_FAULTY = "(" + " union all ".join(f"select manifest_id, {i} as fault, " + ", ".join(f"{v} as {c}" if c == col else c for c in ("name", "mode", "size", "digest")) + " from entries" for i, (col, v, *_) in enumerate(_FAULTS)) + ")"


@query(f"select manifest_id, fault, severity, code, message, count(*) as n from ({_rules_sql(_FAULTY)}) group by all")
def row_rules(spark, folder):
    """Every row once with each of a list of faults: the issues found, by fault."""
    e = _entries(spark, folder)
    # the number of the fault goes along as the row's order, of which an issue's line is the next
    faulty = [e.withColumn(col, F.expr(value).cast(e.schema[col].dataType)).withColumn("ord", F.lit(i).cast("long")) for i, (col, value, *_) in enumerate(_FAULTS)]
    rows = faulty[0]
    for f in faulty[1:]:
        rows = rows.unionByName(f)
    found = validate.row_issues(rows).withColumn("fault", (F.col("line") - 1).cast("int"))
    return found.groupBy("manifest_id", "fault", "severity", "code", "message").agg(F.count(F.lit(1)).alias("n"))


@query(
    "with i as (select manifest_id, severity, code from (" + _rules_sql("(select *, 0 as fault from entries)") + ")"
    " union all select manifest_id, 'error', 'path_duplicate' from (select *, min(ord) over (partition by manifest_id, path) as first from entries where path is not null) where ord > first"
    " union all select manifest_id, 'error', 'depth_jump' from (select manifest_id, ord, depth, lag(depth) over (partition by manifest_id order by ord) as before from (select manifest_id, ord, max(depth) as depth from entries where ord is not null and depth is not null group by all)) where depth > coalesce(before, -1) + 1)"
    " select manifest_id, severity, code, count(*) as n from i group by all"
)
def validate_issues(spark, folder):
    return validate.validate(_entries(spark, folder)).groupBy("manifest_id", "severity", "code").agg(F.count(F.lit(1)).alias("n"))


# --- identity of sets and directories, with a hash that SQL has as well


@query(
    "with recursive d as (select manifest_id, digest, row_number() over (partition by manifest_id order by digest) as n, count(*) over (partition by manifest_id) as size from (select distinct manifest_id, digest from entries where digest is not null)),"
    " t as (select manifest_id, digest, n, size, 0 as level from d union all"
    " select manifest_id, case when count(*) = 1 then min(digest) else unhex(sha256(min(digest) || max(digest))) end, (n - 1) // 2 + 1, (any_value(size) + 1) // 2, any_value(level) + 1 from t where size > 1 group by manifest_id, (n - 1) // 2)"
    " select manifest_id, lower(hex(digest)) as tree_digest from t where size = 1"
)
def set_identity_sha256(spark, folder):
    """The identity of each manifest's set of digests, by the construction of set IDs on SHA-256."""
    got = ident.set_identity(_entries(spark, folder).select("manifest_id", "digest"), "manifest_id", bits=256)
    return got.select("manifest_id", ident.hex_text(F.col("tree_digest")).alias("tree_digest"))


_KEY = _PARTS.replace("(c,", "(name,")


def _rolled_sql(bare: bool, empty: str) -> str:
    """Recursive tables that end in u: all rows with sizes and times filled, at lvl = -1. A step fills the
    directories of one depth. bare: what directories state is left out. empty: size of an empty one."""
    own = lambda c: f"case when path like '%/' then null else {c} end as {c}" if bare else c
    size, time = f"strlen({BARE_LINE}) + 1 + case when digest is not null and digest <> {_NIL} then 90 else 1 end + 1 as bytes", "case when k.nt = k.n then k.ts end"
    rest = "name, digest, mode, target, hard_link, flow_direction, flow_target, is_sequence"
    return f"""base as (select manifest_id, path, parent, depth, path like '%/' as is_d, {own("ts")}, {own("size")}, {rest} from {{LAST}} where depth is not null),
u as (select manifest_id, path, parent, depth, is_d, size, ts, {rest}, {size}, (select max(depth) from base) as lvl from base where not is_d
  union all select * from (
    with w as (select * from u),
    k as (select manifest_id, parent, count(*) as n, count(size) as ns, count(ts) as nt, sum(size + bytes)::bigint as total, max(ts) as ts from w where parent is not null and depth = lvl + 1 group by all),
    f as (select b.manifest_id, b.path, b.parent, b.depth, coalesce(b.size, case when k.n is null then {empty} when k.ns = k.n then k.total end) as size, coalesce(b.ts, {time}) as ts, {", ".join("b." + c.strip() for c in rest.split(","))}, (select max(lvl) from w) as lvl
      from base b left join k on k.manifest_id is not distinct from b.manifest_id and k.parent = b.path where b.is_d and b.depth = (select max(lvl) from w))
    select manifest_id, path, parent, depth, is_d, size, ts, {rest}, bytes, lvl - 1 from w where lvl >= 0
    union all select manifest_id, path, parent, depth, true, size, ts, {rest}, {size.replace(" as bytes", "")}, lvl - 1 from f where lvl >= 0))"""


@query(f"with recursive {_rolled_sql(True, '0')} select manifest_id, path, size, epoch_us(ts) as us from u where is_d and lvl = -1")
def rolled_directories(spark, folder):
    """Size and time of every directory with those it states left out."""
    d = _entries(spark, folder)
    bare = d.withColumn("size", F.when(~F.col("path").endswith("/"), F.col("size"))).withColumn("ts", F.when(~F.col("path").endswith("/"), F.col("ts")))
    return rollup.roll_up(bare).where(F.col("path").endswith("/")).select("manifest_id", "path", "size", F.unix_micros("ts").alias("us"))


@query(f"with recursive {_rolled_sql(False, '0')} select manifest_id, path, size, epoch_us(ts) as us from u where lvl = -1")
def rolled_listings(spark, folder):
    """All rows with the sizes and times that directories lack."""
    return rollup.roll_up(_entries(spark, folder)).select("manifest_id", "path", "size", F.unix_micros("ts").alias("us"))


_HEX = f"case when digest <> {_NIL} then lower(hex(digest)) end"


@query(
    f"with recursive base as (select manifest_id, path, parent, depth, path like '%/' as is_d, {_KEY} as key, {BARE_LINE} as line, {_HEX} as id from {{LAST}} where depth is not null),"
    " u as (select manifest_id, path, parent, depth, is_d, key, line, id, (select max(depth) from base) as lvl from base where not is_d union all select * from (with w as (select * from u),"
    " k as (select manifest_id, parent, sha256(string_agg(line || ' ' || coalesce(id, '-') || chr(10), '' order by is_d, key)) as id from w where parent is not null and depth = lvl + 1 group by all),"
    " f as (select b.* exclude (id), coalesce(k.id, sha256('')) as id, (select max(lvl) from w) as lvl from base b left join k on k.manifest_id is not distinct from b.manifest_id and k.parent = b.path where b.is_d and b.depth = (select max(lvl) from w))"
    " select manifest_id, path, parent, depth, is_d, key, line, id, lvl - 1 from w where lvl >= 0 union all select manifest_id, path, parent, depth, is_d, key, line, id, lvl - 1 from f where lvl >= 0))"
    " select manifest_id, path, id from u where is_d and lvl = -1"
)
def directory_hashes_sha256(spark, folder):
    """Every directory's hash over the lines of what it holds, by the construction of directory IDs on SHA-256."""
    d = rollup.directory_ids(_entries(spark, folder), bits=256).where(F.col("path").endswith("/"))
    return d.select("manifest_id", "path", ident.hex_text(F.col("digest")).alias("id"))


@query(
    f"with recursive {_rolled_sql(False, 'null')}, t as (select *, {_KEY} as key, min(depth) over (partition by manifest_id) as top from u where lvl = -1)"
    f" select manifest_id, sha256(string_agg({BARE_LINE} || ' ' || coalesce({_HEX}, '-') || chr(10), '' order by is_d, key)) as id from t where depth = top group by manifest_id"
)
def manifest_hashes_sha256(spark, folder):
    """Every manifest's hash, by the construction of manifest IDs on SHA-256."""
    return rollup.manifest_ids(_entries(spark, folder), bits=256).select("manifest_id", ident.hex_text(F.col("digest")).alias("id"))


@query(
    f"with recursive {_rolled_sql(False, 'null')}, t as (select *, {_KEY} as key, min(depth) over (partition by manifest_id) as top from u where lvl = -1),"
    f" h as (select manifest_id, sha256(string_agg({BARE_LINE} || ' ' || coalesce({_HEX}, '-') || chr(10), '' order by is_d, key)) as id from t where depth = top group by manifest_id)"
    " select p.manifest_id, h.id, (select count(*) from {LAST} e where e.manifest_id = p.prev2) as entry_count from {PAIRS} p join h on h.manifest_id = p.prev2 where p.prev2 is not null"
)
def chain_base_hashes_sha256(spark, folder):
    """The hash that a chain's log gives its first version, for all chains of three listings."""
    log = versions.log_chain(_chain(spark, folder), bits=256).where("is_base")
    return log.select("manifest_id", ident.hex_text(F.col("digest")).alias("id"), "entry_count")
