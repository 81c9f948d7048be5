"""Statistics that turn ORFs into weights: RBS histograms and odds, GC frame plot, frame bias, coding potential."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.codes import start_weight
from ..functions.seq import genome_pstop
from . import kernels as K

BINS = 28


def _histogram(scored: DataFrame, contigs: DataFrame, total) -> DataFrame:
    """(contig_id, score, p) with one pseudocount in each of the bins."""
    grid = contigs.select("contig_id", "len", F.explode(F.sequence(F.lit(0), F.lit(BINS - 1))).alias("score"))
    counts = scored.groupBy("contig_id", "score").agg(F.count("*").alias("n"))
    filled = grid.join(counts, ["contig_id", "score"], "left").withColumn("n", F.coalesce("n", F.lit(0)) + 1)
    return filled.select("contig_id", "score", (F.col("n") / total).alias("p"))


def score_counts(contigs: DataFrame) -> DataFrame:
    """(contig_id, len, score, n_ahead, n_back): how many positions have each RBS score, on either strand."""

    def found(seq: bytes):
        ahead, back = (np.bincount(s, minlength=BINS) for s in K.position_scores(K.codes_of(seq))) if seq else np.zeros((2, BINS), np.int64)
        return [np.arange(BINS), ahead, back], BINS

    return K.per_contig(contigs, found, [("score", "int", pa.int32()), ("n_ahead", "long", pa.int64()), ("n_back", "long", pa.int64())], keep=("contig_id", "len"))


def rbs_background(contigs: DataFrame) -> DataFrame:
    """Scores of the window from every position, on both strands, with one pseudocount in each of the bins."""
    return score_counts(contigs).select("contig_id", "score", ((F.col("n_ahead") + F.col("n_back") + 1) / (2 * F.col("len") + BINS)).alias("p"))


def rbs_training(orfs: DataFrame, contigs: DataFrame) -> DataFrame:
    some = contigs.join(orfs.groupBy("contig_id").agg(F.count("*").alias("n_orfs")), "contig_id")
    return _histogram(orfs.select("contig_id", F.col("rbs_score").alias("score")), some, F.sum("n").over(Window.partitionBy("contig_id")))


def rbs_odds(orfs: DataFrame, contigs: DataFrame) -> DataFrame:
    """(contig_id, score, odds): training over background."""
    both = rbs_training(orfs, contigs).withColumnRenamed("p", "q").join(rbs_background(contigs), ["contig_id", "score"])
    return both.select("contig_id", "score", (F.col("q") / F.col("p")).alias("odds"))


def gc_frame(contigs: DataFrame) -> DataFrame:
    """(contig_id, pos, gc1, gc2, gc3): G or C among forty in-frame bases around a position and its two followers."""

    def found(seq: bytes):
        if len(seq) < 3:
            return None
        t = K.gc_counts(K.codes_of(seq))
        return [np.arange(1, len(t) - 1), t[:-2], t[1:-1], t[2:]], len(t) - 2

    return K.per_contig(contigs, found, [(n, "int", pa.int32()) for n in ("pos", "gc1", "gc2", "gc3")])


def training_orfs(orfs: DataFrame) -> DataFrame:
    """The longest ORF with start atg of each stop position."""
    span = F.abs(F.col("start") - F.col("stop"))
    best = orfs.where("start_codon = 'atg'").groupBy("contig_id", "stop").agg(F.max_by(F.struct("start", "frame"), F.struct(span, F.col("frame"))).alias("o"))
    return best.select("contig_id", "o.start", "stop", "o.frame")


def _with_spans(contigs: DataFrame, spans: DataFrame, how: str = "inner") -> DataFrame:
    """contigs with rows (array of structs of all columns of spans) and their start, stop and frame as arrays."""
    names = [c for c in spans.columns if c != "contig_id"]
    rows = spans.groupBy("contig_id").agg(F.collect_list(F.struct(*names)).alias("rows"))
    both = contigs.select("contig_id", "seq").join(rows, "contig_id", how)
    return both.select("contig_id", "seq", "rows", *(F.col(f"rows.{c}").alias(c) for c in ("start", "stop", "frame")))


def frame_bias(training: DataFrame, contigs: DataFrame) -> DataFrame:
    """(contig_id, idx, pmax, pmin): how often each codon position has most or least G and C in training ORFs, over the
    largest count; one pseudocount each. A training ORF's first eighths and last 12 codons are left out."""

    def found(seq: bytes, start: np.ndarray, stop: np.ndarray, frame: np.ndarray):
        counts = np.zeros((2, 3))
        if len(start):
            x = K.codes_of(seq)
            skip = np.abs(stop - start) // 8 * 3
            ahead = frame > 0
            # pair_counts takes forward codons at start ... stop - 3 and reverse ones at stop + 3 ... start.
            first = np.where(ahead, start + skip, start - skip)
            last = np.where(ahead, first + ((stop - 37 - first) // 3 + 1) * 3, first - ((first - (stop + 37)) // 3 + 1) * 3)
            some = np.where(ahead, first <= stop - 37, first >= stop + 37)
            pairs = K.pair_counts(x, first[some], last[some], frame[some]).sum(0).reshape(3, 3)
            counts = np.stack([pairs.sum(1), pairs.sum(0)])
        counts = counts + 1
        top = counts / np.maximum(counts.max(1, keepdims=True), 1)
        return [np.arange(1, 4), top[0], top[1]], 3

    spans = _with_spans(contigs, training, "left")
    return K.per_contig(spans, found, [("idx", "int", pa.int32()), ("pmax", "double", pa.float64()), ("pmin", "double", pa.float64())], "start", "stop", "frame")


def orf_hold(orfs: DataFrame, contigs: DataFrame, bias: DataFrame) -> DataFrame:
    """orfs with ln_hold: ln(1 - pstop) times the sum over its codons of the bias of the frames with most and least G and C.

    Counts of the nine pairs of frames are prefix sums over the contig, so an ORF costs two lookups and no scan of its own.
    """
    wide = bias.groupBy("contig_id").agg(F.sort_array(F.collect_list(F.struct("idx", "pmax", "pmin"))).alias("p")).select("contig_id", F.col("p.pmax").alias("pmax"), F.col("p.pmin").alias("pmin"))

    def found(seq: bytes, start: np.ndarray, stop: np.ndarray, frame: np.ndarray, pmax: np.ndarray, pmin: np.ndarray):
        counts = K.pair_counts(K.codes_of(seq), start, stop, frame)
        return [[(counts * np.outer(pmax, pmin).ravel()).sum(1).tolist()]], 1

    spans = _with_spans(contigs, orfs).join(wide, "contig_id")
    totals = K.per_contig(spans, found, [("totals", "array<double>", pa.list_(pa.float64()))], "start", "stop", "frame", "pmax", "pmin", keep=("contig_id", "rows"))
    held = totals.select("contig_id", F.explode(F.arrays_zip("rows", "totals")).alias("z"))
    names = [c for c in orfs.columns if c != "contig_id"]
    return held.select("contig_id", *(F.col(f"z.rows.{c}").alias(c) for c in names), (F.log(1 - F.col("z.rows.pstop")) * F.col("z.totals")).alias("ln_hold"))


def scored_orfs(contigs: DataFrame, orfs: DataFrame, table: int = 11) -> DataFrame:
    """orfs with weight_rbs, ln_hold, ln_weight (of the weight's size) and weight, infinite where that exceeds a double."""
    bias = frame_bias(training_orfs(orfs), contigs)
    odds = rbs_odds(orfs, contigs).select("contig_id", F.col("score").alias("rbs_score"), F.col("odds").alias("weight_rbs"))
    held = orf_hold(orfs, contigs, bias).join(odds, ["contig_id", "rbs_score"])
    start = start_weight(F.col("start_codon"), table)
    held = held.withColumn("ln_weight", -F.col("ln_hold") + F.log(start) + F.log("weight_rbs"))
    hold = F.exp("ln_hold")
    return held.withColumn("weight", -F.when(hold == 0, float("inf")).otherwise(1 / hold) * start * F.col("weight_rbs"))


def contig_pstop(contigs: DataFrame) -> DataFrame:
    return contigs.select("contig_id", genome_pstop(F.col("seq")).alias("pstop"))
