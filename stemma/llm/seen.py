"""Has a key been seen before? Golomb-coded sets over hashed keys, and the rate of wrong answers.

Every key is hashed to ``range_bits`` bits: enough that a key not in the set hits a value of it with
a chance of at most 2**-fp_bits. The set remembers for each value when it first occurred (0: among
the earlier keys, else the number of the record) and whether two different keys fell on it, told by
a second, independent 64-bit hash. A record's key was seen if its value first occurred before the
record. Values with two keys are the only ones that can be wrong; their keys are compared byte by
byte afterwards.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stemma.llm.golomb import decode_block, encode_block
from stemma.runtime import written

BLOCK_KEYS = 512
BLOCK_SCHEMA = "block long, n int, k int, width int, unary binary, rest binary, notes binary"
_NIL = bytes(64)


@dataclass(frozen=True)
class Layout:
    """range_bits: width of reduced hashes. block_bits: width of the part that names the block."""

    range_bits: int
    block_bits: int

    @classmethod
    def for_rows(cls, rows: int, fp_bits: int) -> "Layout":
        """fp_bits as asked for; an error where they don't fit into a 63-bit value (20 bits: from 2**43 rows on)."""
        bits = math.ceil(math.log2(max(2, rows))) + fp_bits
        if bits > 63:
            raise ValueError(f"{rows} rows leave {63 - bits + fp_bits} bits against false positives, not {fp_bits}")
        return cls(bits, max(0, math.ceil(math.log2(max(1, rows / BLOCK_KEYS)))))

    @property
    def span_bits(self) -> int:
        return self.range_bits - self.block_bits


def _value(key: Column, layout: Layout) -> Column:
    return F.shiftrightunsigned(F.xxhash64(key), 64 - layout.range_bits)


def _known(key: Column) -> Column:
    """Keys that count: neither null nor nil."""
    return key.isNotNull() & (key != F.lit(_NIL))


def build_set(keys: DataFrame, layout: Layout) -> DataFrame:
    """Blocks of the Golomb-coded set. keys: (key, first), first >= 0; repeated keys keep the least.

    Only hashes are shuffled, combined map-side, so a key of any frequency moves once per task.
    """
    h = keys.select(_value(F.col("key"), layout).alias("v"), F.col("first"), F.xxhash64(F.lit(1), F.col("key")).alias("other"))
    one = h.groupBy("v").agg(F.min("first").alias("first"), F.min("other").alias("a"), F.max("other").alias("b"))
    note = F.shiftleft(F.col("first"), 1) + F.when(F.col("a") != F.col("b"), 1).otherwise(0)
    span = layout.span_bits

    def run(batches):
        def coded(block, v, notes):
            cuts = np.flatnonzero(np.diff(block)) + 1
            rows = []
            for lo, hi in zip([0, *cuts], [*cuts, len(block)]):
                b = int(block[lo])
                rows.append({"block": b} | encode_block(v[lo:hi], b << span, span, notes[lo:hi]))
            return pa.RecordBatch.from_pylist(rows, schema=_ARROW)

        rest = [np.zeros(0, np.int64)] * 3
        for batch in batches:
            cols = [np.concatenate([r, c.to_numpy()]) for r, c in zip(rest, batch.columns)]
            if not len(cols[0]):
                continue
            keep = int(np.searchsorted(cols[0], cols[0][-1]))  # the last block may go on in the next batch
            rest = [c[keep:] for c in cols]
            if keep:
                yield coded(*[c[:keep] for c in cols])
        if len(rest[0]):
            yield coded(*rest)

    placed = one.select(F.shiftright("v", span).alias("block"), "v", note.alias("note"))
    return placed.repartition("block").sortWithinPartitions("block", "v").mapInArrow(run, BLOCK_SCHEMA)


_ARROW = pa.schema([("block", pa.int64()), ("n", pa.int32()), ("k", pa.int32()), ("width", pa.int32()), ("unary", pa.binary()), ("rest", pa.binary()), ("notes", pa.binary())])


def probe_set(blocks: DataFrame, probes: DataFrame, layout: Layout) -> DataFrame:
    """(v, first, shared) of the probed values that occurred before ``last``. probes: distinct (v, last).

    Only blocks that a probe falls into are decoded. A block's probes are distinct hash values, so
    they are about as many as its keys whatever the skew of the records.
    """
    span = layout.span_bits
    by_block = probes.groupBy(F.shiftright("v", span).alias("block")).agg(F.sort_array(F.collect_list(F.struct("v", "last"))).alias("probes"))

    def run(batches):
        for batch in batches:
            vs, firsts = [], []
            block_no = batch.column(0).to_pylist()
            cols = {name: batch.column(batch.schema.get_field_index(name)).to_pylist() for name in ("n", "k", "width", "unary", "rest", "notes")}
            lists = batch.column(batch.schema.get_field_index("probes"))
            offsets, flat = lists.offsets.to_numpy(), lists.values
            pv, pl = flat.field("v").to_numpy(), flat.field("last").to_numpy()
            for i, b in enumerate(block_no):
                values, notes = decode_block({k: c[i] for k, c in cols.items()}, b << span)
                v, last = pv[offsets[i] : offsets[i + 1]], pl[offsets[i] : offsets[i + 1]]
                at = np.minimum(np.searchsorted(values, v), len(values) - 1)
                hit = (values[at] == v) & ((notes[at] >> 1) < last)
                vs.append(v[hit])
                firsts.append(notes[at][hit])
            if vs:
                note = np.concatenate(firsts)
                yield pa.RecordBatch.from_pydict({"v": pa.array(np.concatenate(vs), pa.int64()), "first": pa.array(note >> 1, pa.int64()), "shared": pa.array((note & 1).astype(bool))})

    return blocks.join(by_block, "block").mapInArrow(run, "v long, first long, shared boolean")


class SeenBefore:
    """Answers for ``records`` (record, key) against ``earlier`` (key) and the records before.

    Record numbers must be unique and above -2**61; they give the order. Records with a null or nil
    key (64 zero bytes) are never seen before and don't count as an occurrence.
    """

    def __init__(self, earlier: DataFrame, records: DataFrame, fp_bits: int = 20):
        self.earlier = earlier.select("key").where(_known(F.col("key")))
        self.records = records.select("record", "key").where(_known(F.col("key")))
        self.rows = earlier.select(F.lit(1)).count() + records.select(F.lit(1)).count()
        self.layout = Layout.for_rows(self.rows, fp_bits)
        least = records.agg(F.min("record")).first()[0]
        self.shift = 1 - least if least is not None else 1  # numbers from 1; 0 stands for the earlier keys
        self.occurrences = self.earlier.select("key", F.lit(0).cast("long").alias("first")).unionByName(self.records.select("key", (F.col("record") + self.shift).alias("first")))
        self.blocks = written(build_set(self.occurrences, self.layout), "gcs")
        h = self.records.select(_value(F.col("key"), self.layout).alias("v"), (F.col("record") + self.shift).alias("n"))
        self.hits = written(probe_set(self.blocks, h.groupBy("v").agg(F.max("n").alias("last")), self.layout), "hits")

    def candidates(self) -> DataFrame:
        """(record, key, shared) that the set says were seen. ``hits`` is a plain table with one row a
        value, so a skewed value on the records' side is split by AQE's skew join."""
        r = self.records.withColumn("v", _value(F.col("key"), self.layout))
        return r.join(self.hits, "v").where(F.col("first") < F.col("record") + self.shift).select("record", "key", "v", "shared")

    def exact(self) -> DataFrame:
        """(key, first) of the keys on values that several keys share."""
        shared = self.hits.where("shared").select("v")
        occ = self.occurrences.withColumn("v", _value(F.col("key"), self.layout)).join(shared, "v", "left_semi")
        return occ.groupBy("key").agg(F.min("first").alias("exact_first"))

    def confirmed(self) -> DataFrame:
        """(record, answer): the candidates, false where the byte comparison refutes the set."""
        c = self.candidates()
        if self.hits.where("shared").limit(1).count() == 0:
            return c.select("record", F.lit(True).alias("answer"))
        sure = c.where("not shared").select("record", F.lit(True).alias("answer"))
        checked = c.where("shared").join(self.exact(), "key").select("record", (F.col("exact_first") < F.col("record") + self.shift).alias("answer"))
        return sure.unionByName(checked)

    def seen(self) -> DataFrame:
        return self.confirmed().where("answer").select("record")

    def report(self) -> DataFrame:
        """One row: size of the set, theoretical rate of false positives and the audited one.

        theoretical_fp: chance that a new key falls on an occupied value. audited_fp: refuted answers
        as a share of the records whose key was new.
        """
        size = self.blocks.agg(
            F.sum("n").cast("long").alias("keys"), F.count(F.lit(1)).alias("blocks"), F.sum(F.length("unary") + F.length("rest")).cast("long").alias("set_bytes"), F.sum(F.length("notes")).cast("long").alias("note_bytes")
        )
        answers = self.confirmed().agg(F.count_if("answer").alias("seen"), F.count_if(~F.col("answer")).alias("false_positives"))
        asked = self.records.agg(F.count(F.lit(1)).alias("asked"))
        # three rows with different columns, laid over each other
        parts = size.unionByName(answers, allowMissingColumns=True).unionByName(asked, allowMissingColumns=True)
        one = parts.agg(*[F.max(c).alias(c) for c in parts.columns])
        return one.select(
            "keys", "blocks", "set_bytes", "note_bytes", "asked", "seen", "false_positives",
            (F.col("set_bytes") * 8 / F.col("keys")).alias("bits_per_key"),
            (F.col("keys") / F.lit(2.0**self.layout.range_bits)).alias("theoretical_fp"),
            (F.col("false_positives") / F.greatest(F.col("asked") - F.col("seen"), F.lit(1))).alias("audited_fp"),
        )


def seen_arrivals(entries: DataFrame, arrivals: DataFrame, fp_bits: int = 20) -> SeenBefore:
    return SeenBefore(entries.select(F.col("digest").alias("key")), arrivals.select(F.col("arrival_id").alias("record"), F.col("actual").alias("key")), fp_bits)
