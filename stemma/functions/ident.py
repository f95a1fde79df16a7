"""Content IDs as columns: digests, their text, set identity."""

from __future__ import annotations

import hashlib

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stemma.functions.base58 import digests_of, parse_id, texts_of_ids
from stemma.functions.base58 import id_text as text_of_one
from stemma.runtime import written
from stemma.schema import NIL


def digest_of(content: Column, bits: int = 512) -> Column:
    """SHA-2 of a binary or string column (strings as UTF-8); IDs have 512 bits."""
    return F.unhex(F.sha2(content.cast("binary"), bits))


@F.pandas_udf(T.StringType())
def id_text(digest: pd.Series) -> pd.Series:
    """ID text of 64-byte digests; null stays null, a digest of another length gives null."""
    return pd.Series(texts_of_ids(digest.tolist()), dtype=object)


@F.pandas_udf(T.BinaryType())
def try_digest(text: pd.Series) -> pd.Series:
    """Digest of ID text, null where the text is no ID."""
    return pd.Series(digests_of([s if isinstance(s, str) else None for s in text]), dtype=object)


@F.pandas_udf(T.BinaryType())
def id_digest(text: pd.Series) -> pd.Series:
    """Digest of ID text; text that is no ID fails the query."""
    texts = [s if isinstance(s, str) else None for s in text]
    out = digests_of(texts)
    for s, d in zip(texts, out):
        if d is None and s is not None:
            parse_id(s)  # says what is wrong
    return pd.Series(out, dtype=object)


def hex_text(digest: Column) -> Column:
    return F.lower(F.hex(digest))


def is_nil(digest: Column) -> Column:
    return digest == F.lit(NIL)


def set_identity(members: DataFrame, *keys: str, bits: int = 512) -> DataFrame:
    """(keys..., tree_digest): identity of each group's set of digests, whatever their order and repeats.

    Sorted distinct digests are paired, each pair hashed smaller first, an odd last one carried over,
    until one is left. bits: width of the hash; that of an ID unless another one is to be compared with. The pairs of a level are groups of their own, so a set of any size spreads over
    many tasks; sets are numbered once, slice by slice of the digest range.
    """
    if not keys:
        return set_identity(members.withColumn("_all", F.lit(1)), "_all", bits=bits).drop("_all")
    level = written(_numbered(members.where("digest is not null").select(*keys, "digest").distinct(), keys), "treeid")
    size = level.groupBy(*keys).agg(F.max("_n").alias("_n")).agg(F.max("_n")).first()[0] or 0
    while size > 1:
        pair = level.groupBy(*keys, F.floor((F.col("_n") - 1) / 2).alias("_p")).agg(F.min("digest").alias("a"), F.max("digest").alias("b"), F.count(F.lit(1)).alias("c"))
        level = written(pair.select(*keys, F.when(F.col("c") == 1, F.col("a")).otherwise(digest_of(F.concat("a", "b"), bits)).alias("digest"), (F.col("_p") + 1).alias("_n")), "treeid")
        size = -(-size // 2)
    return level.select(*keys, F.col("digest").alias("tree_digest"))


def _numbered(members: DataFrame, keys) -> DataFrame:
    """Position of each digest within its group, from 1, without sorting a group in one task.

    Digests are hashes, so equal slices of their range hold about equally many: each slice is sorted
    alone, and the slices' counts are summed up.
    """
    slices = 4096
    first = F.conv(F.hex(F.substring("digest", 1, 2)), 16, 10).cast("int")
    m = members.withColumn("_s", F.floor(first / (65536 // slices)))
    before = m.groupBy(*keys, "_s").agg(F.count(F.lit(1)).alias("_c"))
    w = Window.partitionBy(*keys).orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    before = before.select(*keys, "_s", F.coalesce(F.sum("_c").over(w), F.lit(0)).alias("_before"))
    inner = Window.partitionBy(*keys, "_s").orderBy("digest")
    return m.withColumn("_i", F.row_number().over(inner)).join(before, [*keys, "_s"]).select(*keys, "digest", (F.col("_before") + F.col("_i")).alias("_n"))


def tree_digest(digests: list[bytes]) -> bytes:
    """Set identity of a few digests on the driver. None gives nil, one gives itself."""
    level = sorted(set(digests))
    if not level:
        return NIL
    while len(level) > 1:
        level = [hashlib.sha512(min(p) + max(p)).digest() if len(p) == 2 else p[0] for p in (level[i : i + 2] for i in range(0, len(level), 2))]
    return level[0]


def streamed_hash(rows: DataFrame, keys: list[str], order: list[str], line: str, bits: int = 512) -> DataFrame:
    """(keys..., digest): SHA-2 over each group's lines, in order, each followed by a line feed.

    A group is one sequential hash by definition, but never held: rows are sorted on disk and fed to
    the hash batch by batch.
    """
    spark_types = {f.name: f.dataType.simpleString() for f in rows.schema}
    schema = ", ".join(f"{k} {spark_types[k]}" for k in keys) + ", digest binary"

    def run(batches):
        current, h = None, None
        for b in batches:
            out_keys, out = [], []
            cols = [b.column(i).to_pylist() for i in range(len(keys) + 1)]
            for row in zip(*cols):
                if row[:-1] != current:
                    if h is not None:
                        out_keys.append(current)
                        out.append(h.digest())
                    current, h = row[:-1], hashlib.new(f"sha{bits}")
                h.update(row[-1].encode() + b"\n")
            if out:
                yield _keyed(out_keys, out)
        if h is not None:
            yield _keyed([current], [h.digest()])

    def _keyed(ks, digests):
        arrays = {k: pa.array([x[i] for x in ks]) for i, k in enumerate(keys)}
        return pa.RecordBatch.from_pydict(arrays | {"digest": pa.array(digests, pa.binary())})

    return rows.repartition(*keys).sortWithinPartitions(*keys, *order).select(*keys, line).mapInArrow(run, schema)
