"""Mixing sources to target shares of tokens by systematic sampling.

Each document of a source has the same expected number of copies. Their running sum, plus one offset
in [0, 1), crosses whole numbers; a document is emitted once for each one crossed within its share.
Documents run in order of size within a source, so the copies' tokens follow the expectation closely.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stemma.llm.encode import TOKENIZER_DIR, token_counts
from stemma.runtime import written


def _strand(rows: int, rows_per_strand: int) -> Column:
    """Part of a source that one task sorts: sizes in sixteenths of a power of two, then a hash."""
    size = F.floor(F.log2(F.col("n_tokens") + 1) * 16).cast("int")
    return F.struct(size.alias("size"), F.pmod(F.xxhash64("doc_id"), F.lit(max(1, -(-rows // rows_per_strand)))).cast("int").alias("part"))


def copy_rates(sized: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, weight, max_repeats, tokens, largest, rate): a source's tokens, those of its largest document
    and the expected copies of each of its documents.

    The mix is as large as it can be with exact shares: the scarcest source is used max_repeats
    times. A source without tokens can't reach its share and has rate 0; the others keep their
    proportions. Targets with a null or non-positive weight or cap have rate 0. A source listed
    twice counts with the sum of its weights and the lowest cap.
    """
    one = targets.where("source is not null").groupBy("source").agg(F.sum("weight").alias("weight"), F.min("max_repeats").alias("max_repeats"))
    have = sized.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.max("n_tokens").alias("largest"))
    t = one.join(have, "source", "left").fillna(0, ["tokens", "largest"])
    usable = (F.col("weight") > 0) & (F.col("max_repeats") > 0) & (F.col("tokens") > 0)
    room = F.when(usable, F.col("max_repeats") * F.col("tokens") / F.col("weight"))
    total = t.agg(F.min(room).alias("total")).scalar()
    rate = F.when(usable, F.least(total * F.col("weight") / F.col("tokens"), F.col("max_repeats").cast("double"))).otherwise(F.lit(0.0))
    return t.select("source", "weight", "max_repeats", "tokens", "largest", F.coalesce(rate, F.lit(0.0)).alias("rate"))


def mix_sources(documents: DataFrame, targets: DataFrame, seed: int = 0, folder: str = TOKENIZER_DIR, rows_per_strand: int = 4_000_000) -> DataFrame:
    """(source, doc_id, copy_no, n_tokens): the mixed corpus, copies numbered from 1.

    Documents of no or an unlisted source are not used. Texts without tokens take part like any
    other. The same seed gives the same mix. A source of any size is summed in strands: only the
    strands' totals, one row for each size class of a source and rows_per_strand documents, are
    summed in one task.
    """
    sized = written(token_counts(documents, folder).where(F.col("source").isNotNull()), "sizes")
    return _mixed(sized, targets, seed, rows_per_strand)


def _mixed(sized: DataFrame, targets: DataFrame, seed: int, rows_per_strand: int) -> DataFrame:
    rates = copy_rates(sized, targets).where("rate > 0").select("source", "rate")
    rows = sized.select(F.lit(1)).count()
    d = sized.join(F.broadcast(rates) if rates.limit(10_001).count() <= 10_000 else rates, "source").withColumn("strand", _strand(rows, rows_per_strand))
    before = Window.partitionBy("source").orderBy("strand").rowsBetween(Window.unboundedPreceding, -1)
    starts = d.groupBy("source", "strand").agg(F.count(F.lit(1)).alias("n")).select("source", "strand", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    inner = Window.partitionBy("source", "strand").orderBy("n_tokens", F.xxhash64("doc_id", F.lit(seed)), "doc_id")
    placed = d.withColumn("i", F.row_number().over(inner)).join(starts, ["source", "strand"])
    at = F.col("start") + F.col("i")
    offset = F.pmod(F.xxhash64(F.lit(seed), F.col("source")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    copies = F.floor(at * F.col("rate") + offset) - F.floor((at - 1) * F.col("rate") + offset)
    drawn = placed.withColumn("copies", copies.cast("int")).where("copies > 0")
    return drawn.select("source", "doc_id", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy_no"), "n_tokens")


def mix_shares(documents: DataFrame, targets: DataFrame, seed: int = 0, folder: str = TOKENIZER_DIR) -> DataFrame:
    """Per target source: its weight, the share reached, tokens, documents and the most copies of one."""
    sized = written(token_counts(documents, folder).where(F.col("source").isNotNull()), "sizes")
    mixed = _mixed(sized, targets, seed, 4_000_000)
    got = mixed.groupBy("source").agg(F.sum("n_tokens").alias("mixed_tokens"), F.count(F.lit(1)).alias("mixed_documents"), F.max("copy_no").alias("most_copies"))
    r = copy_rates(sized, targets).join(got, "source", "left").fillna(0, ["mixed_tokens", "mixed_documents", "most_copies"])
    share = F.col("mixed_tokens") / F.sum("mixed_tokens").over(Window.partitionBy(F.lit(1)))
    return r.select("source", "weight", "max_repeats", "tokens", "largest", "rate", "mixed_tokens", "mixed_documents", "most_copies", share.alias("share"))
