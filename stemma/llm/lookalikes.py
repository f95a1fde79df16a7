"""Names that look the same but differ in their characters, brought to one form.

A name is folded character by character (width, joined letters, spaces, invisible characters,
letters of other scripts that look Latin); folded names are grouped in SQL under the accent- and
case-sensitive Unicode collation, each class takes a canonical member, and that is joined back.
Which letters look Latin is read from the Unicode confusables data that comes with Spark.
"""

from __future__ import annotations

import functools
import sys
import unicodedata

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stemma.runtime import written

# Characters without a glyph that aren't of category Cf.
INVISIBLE = "͏ᅟᅠ឴឵᠋᠌᠍᠎᠏ㅤﾠ"


@functools.cache
def lookalike_letters(spark: SparkSession) -> dict[int, str]:
    """ASCII letter of each other letter that looks like it, in the same case.

    By rule from the confusables data: both have one skeleton. A capital takes a capital, a small letter a
    small one; one without case takes either. What looks like i or j must have their dot, as a missing one
    shows. Digits and signs aren't letters, and letters with accents are seen part by part.
    """
    icu = spark._jvm.com.ibm.icu.text
    checker = getattr(icu, "SpoofChecker$Builder")().build()
    dotted = icu.UnicodeSet("[:Soft_Dotted:]")
    letters = [ch for ch in map(chr, range(128, sys.maxunicode + 1)) if (unicodedata.category(ch)[0] == "L" or unicodedata.category(ch) == "Nl") and unicodedata.normalize("NFD", ch) == ch]
    ascii_letters = [chr(c) for c in range(128) if chr(c).isalpha()]
    skeletons = checker.getSkeleton("\n".join([*ascii_letters, *letters])).split("\n")
    latin: dict[str, list[str]] = {}
    for ch, skeleton in zip(ascii_letters, skeletons):
        latin.setdefault(skeleton, []).append(ch)
    out = {}
    for ch, skeleton in zip(letters, skeletons[len(ascii_letters) :]):
        same = [x for x in latin.get(skeleton, []) if not (ch.isupper() and x.islower()) and not (ch.islower() and x.isupper())]
        if same and (same[-1] not in "ij" or dotted.contains(ord(ch))):
            out[ord(ch)] = same[-1]  # a small letter before a capital
    return out


def folding(letters: dict[int, str]) -> dict[int, str | None]:
    """Translation of single characters, applied to canonically decomposed text. letters: lookalike_letters().

    By rule from the Unicode data: wide and narrow forms, and compatibility forms made of several
    letters (ligatures), become their parts; separators of category Zs become a space; category Cf
    and variation selectors vanish. ASCII maps to itself.
    """
    # a wide or joined form can hold a look-alike or a further form
    return {k: v and v.translate(letters) for k, v in _forms().items()} | letters


@functools.cache
def _forms() -> dict[int, str | None]:
    out: dict[int, str | None] = {}
    for code in range(128, sys.maxunicode + 1):
        ch = chr(code)
        kind = unicodedata.category(ch)
        if kind in ("Cn", "Cs", "Co", "Lo") and not (0xFF61 <= code <= 0xFFDC or 0xFB1D <= code <= 0xFDFF):
            continue
        tag, *parts = unicodedata.decomposition(ch).split() or [""]
        if kind == "Cf" or 0xFE00 <= code <= 0xFE0F or 0xE0100 <= code <= 0xE01EF:
            out[code] = None
        elif kind == "Zs":
            out[code] = " "
        elif tag in ("<wide>", "<narrow>"):
            out[code] = "".join(chr(int(p, 16)) for p in parts)
        elif tag == "<compat>" and len(parts) > 1 and all(unicodedata.category(chr(int(p, 16)))[0] == "L" for p in parts):
            out[code] = "".join(chr(int(p, 16)) for p in parts)
    return out | {ord(ch): None for ch in INVISIBLE}


def folded(name: str, table: dict[int, str | None]) -> str:
    """One form of all names that look like ``name``; ASCII names are their own. table: folding()."""
    if name.isascii():
        return name
    parts = unicodedata.normalize("NFD", name).translate(table)
    return unicodedata.normalize("NFC", unicodedata.normalize("NFD", parts).translate(table))


def _with_forms(rows: DataFrame, schema: str) -> DataFrame:
    letters = lookalike_letters(rows.sparkSession)

    def run(batches):
        table = folding(letters)
        for b in batches:
            names = b.column(b.schema.get_field_index("name")).dictionary_encode()  # names repeat in every listing
            forms = pa.array([folded(x, table) for x in names.dictionary.to_pylist()], pa.string())
            yield b.append_column("form", forms.take(names.indices))

    return rows.mapInArrow(run, schema + ", form string")


def name_classes(entries: DataFrame) -> DataFrame:
    """(class, manifest_id, path, name, canonical) of all paths in classes of two or more paths.

    A class is the paths of one manifest and parent whose names look the same. The canonical name is
    the member that is ASCII if there is one, else the first in code-point order of its folded form
    and then of itself. Repeated rows count once; null names, paths and manifests are left out; a null parent
    is one parent. ASCII names differ from each other, so only those equal to the folded form of
    some other name take part in the grouping.
    """
    spark = entries.sparkSession
    rows = entries.where("manifest_id is not null and name is not null and path is not null").select("manifest_id", "parent", "path", "name")
    plain = ~F.col("name").rlike(r"[^\x00-\x7F]") & (F.col("path") == F.concat(F.coalesce("parent", F.lit("")), "name"))
    odd = rows.where(~F.coalesce(plain, F.lit(False))).distinct()
    odd = written(_with_forms(odd, "manifest_id string, parent string, path string, name string"), "forms")
    keys = odd.select(F.col("manifest_id").alias("k_manifest"), F.col("parent").alias("k_parent"), F.col("form").alias("k_form")).where(~F.col("form").rlike(r"[^\x00-\x7F]")).distinct()
    like = (F.col("manifest_id") == F.col("k_manifest")) & F.col("parent").eqNullSafe(F.col("k_parent")) & (F.col("name") == F.col("k_form"))
    ascii_rows = rows.where(plain).select("manifest_id", "parent", "name").join(keys, like, "left_semi").distinct()
    ascii_rows = ascii_rows.select("manifest_id", "parent", F.concat(F.coalesce("parent", F.lit("")), "name").alias("path"), "name", F.col("name").alias("form"))
    # ASCII control characters differ but don't count in a collation: forms with them are compared as they are
    members = odd.unionByName(ascii_rows).withColumn("controls", F.when(F.col("form").rlike(r"[\x00-\x1F\x7F]"), F.col("form")).otherwise(""))
    members = written(members, "members")  # read twice; the names behind them are far more
    classes = spark.sql(
        r"""
        select manifest_id, parent, collate(form, 'UNICODE') as class_form, controls,
               min(struct(name rlike '[^\x00-\x7F]' as odd, form, name)).name as canonical
        from {members} group by manifest_id, parent, collate(form, 'UNICODE'), controls having count(distinct path) > 1
        """,
        members=members,
    )
    # numbered and written, so that what follows knows a class by one number
    classes = written(classes.withColumn("class", F.monotonically_increasing_id()).withColumn("class_form", F.collate("class_form", "UTF8_BINARY")), "classes")
    return spark.sql(
        """
        select c.class, m.manifest_id, m.path, m.name, c.canonical
        from {members} m join {classes} c on m.manifest_id = c.manifest_id and m.parent <=> c.parent
                     and collate(m.form, 'UNICODE') = collate(c.class_form, 'UNICODE') and m.controls = c.controls
        """,
        members=members,
        classes=classes,
    )


def lookalike_pairs(entries: DataFrame) -> DataFrame:
    """(manifest_id, path_lo, path_hi): every pair of paths of a class, in code-point order.

    The rows are as many as a class has pairs, so they grow with the square of its size; classes of
    thousands of names are better read from name_classes, one row a path.
    """
    m = written(name_classes(entries), "members")
    a = m.select("class", "manifest_id", F.col("path").alias("path_lo"))
    b = m.select(F.col("class").alias("c2"), F.col("path").alias("path_hi"))
    return a.join(b, (F.col("class") == F.col("c2")) & (F.col("path_lo") < F.col("path_hi"))).select("manifest_id", "path_lo", "path_hi")
