"""Queries of the text operators and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stemma.llm.encode import encode_documents
from stemma.llm.languages import detect_languages, label_faults
from stemma.llm.lookalikes import lookalike_pairs, name_classes
from stemma.llm.mix import mix_shares, mix_sources
from stemma.llm.seen import seen_arrivals
from stemma.runtime import table


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return lookalike_pairs(table(spark, folder, "entries"))


def p2_canonical(spark: SparkSession, folder: str) -> DataFrame:
    return name_classes(table(spark, folder, "entries")).select("manifest_id", "path", "canonical")


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return seen_arrivals(table(spark, folder, "entries"), table(spark, folder, "arrivals")).seen().withColumnRenamed("record", "arrival_id")


def p4_report(spark: SparkSession, folder: str) -> DataFrame:
    return seen_arrivals(table(spark, folder, "entries"), table(spark, folder, "arrivals")).report()


def p4_counts(spark: SparkSession, folder: str) -> DataFrame:
    """The exact part of the report: records with a key, those seen before, and refuted answers left in."""
    s = seen_arrivals(table(spark, folder, "entries"), table(spark, folder, "arrivals"))
    r = s.report().select("asked", "seen")
    return r.withColumn("answered", F.lit(s.seen().count()).cast("long"))


def p7_ids(spark: SparkSession, folder: str) -> DataFrame:
    return encode_documents(table(spark, folder, "documents"))


def p8_mix(spark: SparkSession, folder: str) -> DataFrame:
    return mix_sources(table(spark, folder, "documents"), table(spark, folder, "mix_targets"))


def p8_shares(spark: SparkSession, folder: str) -> DataFrame:
    return mix_shares(table(spark, folder, "documents"), table(spark, folder, "mix_targets"))


def p8_targets(spark: SparkSession, folder: str) -> DataFrame:
    """Whether each source's tokens are those its weight asks for, to twice its largest document, and no
    document is used more often than allowed."""
    r = mix_shares(table(spark, folder, "documents"), table(spark, folder, "mix_targets"))
    whole = r.agg(F.sum(F.col("rate") * F.col("tokens"))).first()[0]
    reached = F.abs(F.col("mixed_tokens") - F.col("weight") * whole) <= 2 * F.col("largest")
    return r.select("source", "weight", reached.alias("reached"), (F.col("most_copies") <= F.col("max_repeats")).alias("within_cap"))


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    return label_faults(table(spark, folder, "documents"), table(spark, folder, "lang_samples"))


def p9_languages(spark: SparkSession, folder: str) -> DataFrame:
    return detect_languages(table(spark, folder, "documents"), table(spark, folder, "lang_samples"))


QUERIES = {q.__name__: q for q in (p2_found, p2_canonical, p4_found, p4_report, p4_counts, p7_ids, p8_mix, p8_shares, p8_targets, p9_found, p9_languages)}

# Look-alike names in plain SQL: single characters by translation tables, then NFC.
# Letters of other scripts that look like a Latin letter of the same case; the SQL's own table, by hand.
CYRILLIC = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "ѕ": "s", "і": "i", "ј": "j", "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w", "ӏ": "l", "ѵ": "v",
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "У": "Y", "Х": "X", "Ѕ": "S", "І": "I", "Ј": "J", "Ү": "Y", "Ԛ": "Q", "Ԝ": "W", "Ӏ": "I", "Ѵ": "V",
}
GREEK = {
    "ο": "o", "ν": "v", "ρ": "p", "ϲ": "c", "ϳ": "j",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "Ϲ": "C", "Ϳ": "J",
}
ARMENIAN = {"օ": "o", "ս": "u", "հ": "h", "ց": "g", "զ": "q", "Օ": "O", "Տ": "S", "Ս": "U"}
_WIDE = "".join(chr(c) for c in range(0xFF01, 0xFF5F))
_NARROW = "".join(chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F))
_LETTERS = CYRILLIC | GREEK | ARMENIAN
_FROM, _TO = "".join(_LETTERS), "".join(_LETTERS.values())
_FORM = f"translate(replace(replace(name, 'ё', 'е' || chr(776)), 'Ё', 'Е' || chr(776)), '{_WIDE}', '{_NARROW.replace(chr(39), chr(39) * 2)}')"
for _joined, _parts in (("ﬀ", "ff"), ("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬃ", "ffi"), ("ﬄ", "ffl")):
    _FORM = f"replace({_FORM}, '{_joined}', '{_parts}')"
_FORM = f"nfc_normalize(translate(regexp_replace(regexp_replace({_FORM}, '[\\p{{Cf}}]', '', 'g'), '[\\p{{Zs}}]', ' ', 'g'), '{_FROM}', '{_TO}'))"

_ODD = f"""with e as (select distinct manifest_id, coalesce(parent, chr(0)) as parent, path, name from entries where manifest_id is not null and name is not null and path is not null),
f as (select *, {_FORM} as form, not regexp_full_match(name, '[\\x00-\\x7F]*') as is_odd from e),
odd as (select * from f where form in (select form from f where is_odd))"""

SQL = {
    "p2_found": f"""{_ODD}
select a.manifest_id, a.path as path_lo, b.path as path_hi from odd a join odd b
  on a.manifest_id = b.manifest_id and a.parent = b.parent and a.form = b.form and a.path < b.path
""",
    "p2_canonical": f"""{_ODD},
c as (select manifest_id, parent, form, arg_min(name, {{'odd': is_odd, 'name': name}}) as canonical from odd group by all having count(distinct path) > 1)
select odd.manifest_id, odd.path, c.canonical from odd join c using (manifest_id, parent, form)
""",
    "p4_counts": """
with a as (select actual, min(arrival_id) over (partition by actual) < arrival_id or actual in (select digest from entries where digest is not null) as seen
           from arrivals where actual is not null and actual <> unhex(repeat('00', 64)))
select count(*) as asked, count(*) filter (where seen) as seen, count(*) filter (where seen) as answered from a
""",
    "p8_targets": "select source, weight, true as reached, true as within_cap from mix_targets",
    "p4_found": """
with a as (select arrival_id, actual, min(arrival_id) over (partition by actual) as first from arrivals
           where actual is not null and actual <> unhex(repeat('00', 64)))
select arrival_id from a where first < arrival_id or actual in (select digest from entries where digest is not null)
""",
}