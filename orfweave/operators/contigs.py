"""Contigs: the text codec of the test tables, positions, codons and runs of n."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Positions are exploded from blocks, as substr scans a string from its start.
BLOCK = 120


def encode_text(text: Column) -> Column:
    """Letters and spaces as bases, by rank modulo four."""
    return F.translate(F.regexp_replace(F.lower(text), "[^a-z ]", ""), "etaoinshrdlcumwfgypbvkjxqz ", "acgtacgtacgtacgtacgtacgtacg")


def contigs_from_documents(spark: SparkSession, sf_dir: str, masked: bool = False) -> DataFrame:
    """(contig_id, seq, len); masked: the letter z becomes n."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("contig_id"), "text")
    seq = encode_text(F.coalesce("text", F.lit("")))
    if masked:
        letters, bases = "etaoinshrdlcumwfgypbvkjxqz ", "acgtacgtacgtacgtacgtacgtang"
        seq = F.translate(F.regexp_replace(F.lower(F.coalesce("text", F.lit(""))), "[^a-z ]", ""), letters, bases)
    # Work per contig is many times its size: a table of few files is dealt out to all cores first.
    out, cores = with_length(docs.select("contig_id", seq.alias("seq"))), spark.sparkContext.defaultParallelism
    return out.repartition(cores, "contig_id") if docs.rdd.getNumPartitions() < cores else out


def with_length(contigs: DataFrame) -> DataFrame:
    return contigs.withColumn("len", F.length("seq"))


def windows_at(contigs: DataFrame, width: int, partial: bool = False) -> DataFrame:
    """(contig_id, len, pos, piece): the piece of `width` bases from each position (1-based); partial: shorter ones at the end."""
    last = F.col("len") if partial else F.col("len") - (width - 1)
    blocks = contigs.where(last >= 1).select("contig_id", "len", F.explode(F.sequence(F.lit(0), ((last - 1) / BLOCK).cast("int"))).alias("b"), "seq")
    pieces = blocks.select("contig_id", "len", (F.col("b") * BLOCK).alias("at"), F.substring("seq", F.col("b") * BLOCK + 1, F.lit(BLOCK + width - 1)).alias("block"))
    room = F.length("block") if partial else F.length("block") - (width - 1)
    offsets = pieces.select("contig_id", "len", "at", "block", F.explode(F.sequence(F.lit(1), F.least(F.lit(BLOCK), room))).alias("o"))
    return offsets.select("contig_id", "len", (F.col("at") + F.col("o")).alias("pos"), F.substring("block", F.col("o"), F.lit(width)).alias("piece"))


def codons(contigs: DataFrame) -> DataFrame:
    """(contig_id, len, pos, frame, codon, rc_codon) for each position but the last two."""
    from ..functions.seq import rev_comp

    return windows_at(contigs, 3).select("contig_id", "len", "pos", ((F.col("pos") - 1) % 3 + 1).cast("int").alias("frame"), F.col("piece").alias("codon"), rev_comp(F.col("piece")).alias("rc_codon"))


def codon_counts(contigs: DataFrame) -> DataFrame:
    """(frame, codon, rc_codon, n) over all contigs: each task counts its own, then at most 375 rows of each are summed."""
    from ..functions.seq import rev_comp
    from . import kernels as K

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((3, 125), np.int64)
        for batch in batches:
            for seq in batch["seq"].cast(pa.binary()):
                x = K.codes_of(seq.as_py() or b"")
                if len(x) >= 3:
                    codon = K.codons_of(x)
                    for f in range(3):
                        total[f] += np.bincount(codon[f::3], minlength=125)
        frame, code = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(frame + 1, pa.int32()), pa.array([K.TRIPLES[c] for c in code], pa.string()), pa.array(total[frame, code])], ["frame", "codon", "n"])

    parts = contigs.select("seq").mapInArrow(counted, "frame int, codon string, n long")
    return parts.groupBy("frame", "codon").agg(F.sum("n").alias("n")).select("frame", "codon", rev_comp(F.col("codon")).alias("rc_codon"), "n")


def n_runs(contigs: DataFrame) -> DataFrame:
    """(contig_id, start, stop): maximal runs of n, read off the pieces between them."""
    runs = contigs.where(F.col("seq").contains("n")).select("contig_id", F.split("seq", "n+", -1).alias("gaps"), F.regexp_extract_all("seq", F.lit("(n+)"), F.lit(1)).alias("runs"))
    each = runs.select("contig_id", "gaps", "runs", F.explode(F.sequence(F.lit(1), F.size("runs"))).alias("i"))
    before = F.aggregate(F.slice("gaps", F.lit(1), F.col("i")), F.lit(0), lambda a, x: a + F.length(x)) + F.aggregate(F.slice("runs", F.lit(1), F.col("i") - 1), F.lit(0), lambda a, x: a + F.length(x))
    return each.select("contig_id", (before + 1).alias("start"), (before + F.length(F.get("runs", F.col("i") - 1))).alias("stop"))


def composition(contigs: DataFrame) -> DataFrame:
    from ..functions.seq import count_base

    counts = [count_base(F.col("seq"), b).cast("long").alias(f"n_{b}") for b in "acgtn"]
    return contigs.select("contig_id", F.col("len").cast("long").alias("len"), *counts)
