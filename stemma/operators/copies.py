"""Differences between two copies of a dataset, by a checksum matrix.

Every key belongs to a bucket. For each bucket and column the matrix holds two sums, over the
bucket's keys, of independent 56-bit hashes of (key, column, value), rows of the left copy counted with
+1 and those of the right with -1. Sums are order-free and combine map-side; a cell whose sums are both
zero means the copies agree there (a differing cell is taken for equal with probability 2**-112; string
and binary values are told apart by 64 bits a column before that). Only buckets with a cell other than
zero are read again, only in the columns that differ anywhere, and only those rows are compared value
by value.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stemma.runtime import prepare, written

_PRESENT = "_present"


@dataclass(frozen=True)
class CopySpec:
    """keys: columns that name a row. order: of several rows with one key the greatest counts.
    fields: columns to compare. prepared frames must hold exactly these columns."""

    keys: Sequence[str]
    order: str
    fields: Sequence[str]


def _key_hash(spec: CopySpec) -> Column:
    return F.xxhash64(*[F.col(k) for k in spec.keys])


def _bucket(spec: CopySpec, n_buckets: int) -> Column:
    return F.pmod(_key_hash(spec), F.lit(n_buckets)).alias("_bucket")


def _both(left: DataFrame, right: DataFrame) -> DataFrame:
    prepare(left.sparkSession)
    return left.withColumn("_side", F.lit(1)).unionByName(right.withColumn("_side", F.lit(-1)))


def _small(df: DataFrame, name: str) -> Column:
    """Value used for hashing: wide values are shuffled as their 64-bit hash."""
    kind = df.schema[name].dataType.simpleString()
    c = F.col(name)
    return F.when(c.isNotNull(), F.xxhash64(c)) if kind in ("binary", "string") else c


def checksum_matrix(left: DataFrame, right: DataFrame, spec: CopySpec, n_buckets: int) -> DataFrame:
    """One row per bucket whose copies differ: ``_bucket`` and a flag for presence and each field.

    Repeated rows of a key are combined before and after one shuffle by key; the sums per bucket are
    combined before a second, small one. Keys are compared as written; a null key part is a value
    of its own. Null values hash apart from every value.
    """
    rows = _both(left, right)
    rows = rows.select(_bucket(spec, n_buckets), "_side", *spec.keys, spec.order, *[_small(left, f).alias(f) for f in spec.fields])
    # a null order comes before every other
    order = F.coalesce(F.col(spec.order), F.lit(-(2**62)))
    last = rows.groupBy("_bucket", "_side", *spec.keys).agg(*[F.max_by(f, order).alias(f) for f in spec.fields])

    key1, key2 = (F.xxhash64(F.lit(seed), *[F.col(k) for k in spec.keys]) for seed in (1, 2))
    last = last.select("_bucket", "_side", *spec.fields, key1.alias("_k1"), key2.alias("_k2"))

    def cell(name: str, value: Column | None) -> list[Column]:
        of = [F.lit(name)] + ([value] if value is not None else [])
        return [F.sum(F.shiftright(F.xxhash64(F.col(k), *of), 8) * F.col("_side")).alias(name + k) for k in ("_k1", "_k2")]

    names = [_PRESENT, *spec.fields]
    sums = last.groupBy("_bucket").agg(*cell(_PRESENT, None), *[c for f in spec.fields for c in cell(f, F.col(f))])
    flags = {n: (F.col(n + "_k1") != 0) | (F.col(n + "_k2") != 0) for n in names}
    return sums.where(reduce(lambda a, b: a | b, flags.values())).select("_bucket", *[flag.alias(n) for n, flag in flags.items()])


def compare_copies(left: DataFrame, right: DataFrame, spec: CopySpec, rows_per_bucket: int = 8) -> DataFrame:
    """Rows (keys..., ``difference``): ``missing`` (only left), ``extra`` (only right) or a field name.

    Empty copies give no rows on their side; both empty give none at all. Exact repeats count once,
    of several rows with one key that with the greatest ``order`` counts. Null equals only null.
    """
    keep = [*spec.keys, spec.order, *spec.fields]
    left, right = left.select(*keep), right.select(*keep)
    n = left.select(F.lit(1)).count() + right.select(F.lit(1)).count()
    n_buckets = max(1, -(-n // (2 * rows_per_bucket)))
    unequal = written(checksum_matrix(left, right, spec, n_buckets), "unequal")
    flags = unequal.agg(*[F.coalesce(F.max(f), F.lit(False)).alias(f) for f in spec.fields]).first()
    fields = [f for f in spec.fields if flags[f]]  # columns equal everywhere aren't read again

    rows = _both(left.select(*spec.keys, spec.order, *fields), right.select(*spec.keys, spec.order, *fields))
    rows = rows.withColumn("_bucket", _bucket(spec, n_buckets)).join(unequal.select("_bucket"), "_bucket", "left_semi")
    order = F.coalesce(F.col(spec.order), F.lit(-(2**62)))

    def side(s: int) -> list[Column]:
        mine = F.col("_side") == s
        own = F.when(mine, order)  # rows of the other side have a null order and never win
        return [F.max(F.when(mine, F.lit(True))).alias(f"_in{s}"), *[F.max_by(F.col(f), own).alias(f"_{f}{s}") for f in fields]]

    pairs = rows.groupBy(*spec.keys).agg(*side(1), *side(-1))
    found = F.when(F.col("_in-1").isNull(), F.array(F.lit("missing"))).when(F.col("_in1").isNull(), F.array(F.lit("extra")))
    changed = [F.when(~F.col(f"_{f}1").eqNullSafe(F.col(f"_{f}-1")), F.lit(f)) for f in fields]
    found = found.otherwise(F.array_compact(F.array(*changed)) if changed else F.array().cast("array<string>"))
    return pairs.select(*spec.keys, F.explode(found).alias("difference"))


ENTRY_FIELDS = ("mode", "ts", "size", "digest", "target")


def prepared_entries(entries: DataFrame) -> DataFrame:
    """Manifest rows in comparable form: canonical mode, whole seconds."""
    from stemma.functions.modes import canonical_mode, whole_seconds

    return entries.select(
        "manifest_id", "path", "ord", canonical_mode(F.col("mode")).alias("mode"), whole_seconds(F.col("ts")).alias("ts"), "size", "digest", "target"
    )


def compare_mirrors(manifests: DataFrame, entries: DataFrame, mirror: DataFrame, rows_per_bucket: int = 8) -> DataFrame:
    """Differences of the mirrored manifests between ``entries`` and ``mirror_entries``.

    A manifest registered twice counts once. ``mirrored`` null counts as false.
    """
    mirrored = manifests.where(F.col("mirrored")).select("manifest_id").distinct()
    left = prepared_entries(entries).join(mirrored, "manifest_id", "left_semi")
    right = prepared_entries(mirror).join(mirrored, "manifest_id", "left_semi")
    return compare_copies(left, right, CopySpec(("manifest_id", "path"), "ord", ENTRY_FIELDS), rows_per_bucket)


def verify_report(manifests: DataFrame, entries: DataFrame, mirror: DataFrame) -> DataFrame:
    """Counts of missing, extra and corrupt paths per manifest (corrupt: at least one field differs)."""
    diffs = compare_mirrors(manifests, entries, mirror)
    return diffs.groupBy("manifest_id").agg(
        F.count_if(F.col("difference") == "missing").alias("missing"),
        F.count_if(F.col("difference") == "extra").alias("extra"),
        F.count_if(~F.col("difference").isin("missing", "extra")).alias("field_differences"),
        F.countDistinct(F.when(~F.col("difference").isin("missing", "extra"), F.col("path"))).alias("corrupt"),
    )
