"""The weighted graph of a contig's ORFs, as DataFrames: nodes, other ends, uncovered runs and seven families of edges.

Nodes are (position, kind, sign, frame). Pairs of nodes closer than `NEAR` are found by a band join on blocks of NEAR
positions, so a contig's work grows with its length and not with its square. Where only near or terminal edges of all ORFs of
whole contigs are wanted, `near_edges_of` and `terminal_edges_of` find them in a map over contigs and shuffle nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.codes import caller_starts, stop_codons
from ..functions.seq import genome_pstop, quantised, score_gap, score_overlap
from . import kernels as K
from .scoring import contig_pstop

NEAR, REACH = 500, 2000
EDGE = ("contig_id", "kind", "src_pos", "src_type", "src_frame", "dst_pos", "dst_type", "dst_frame", "weight")


def nodes(orfs: DataFrame) -> DataFrame:
    """(contig_id, pos, type, frame): distinct ends of ORFs."""
    ends = F.explode(F.array(F.struct(F.col("start").alias("pos"), F.lit("start").alias("type")), F.struct(F.col("stop").alias("pos"), F.lit("stop").alias("type"))))
    return orfs.select("contig_id", "frame", ends.alias("e")).select("contig_id", "e.pos", "e.type", "frame").distinct()


def other_end(orfs: DataFrame) -> DataFrame:
    """(contig_id, pos, other): the farthest start of a stop, the stop of a start; a start's entry wins a collision."""
    stops = orfs.groupBy("contig_id", F.col("stop").alias("pos")).agg(F.min("start").alias("lo"), F.max("start").alias("hi"), F.max("frame").alias("frame"))
    by_stop = stops.select("contig_id", "pos", F.when(F.col("frame") > 0, F.col("lo")).otherwise(F.col("hi")).alias("other"), F.lit(0).alias("rank"))
    by_start = orfs.groupBy("contig_id", F.col("start").alias("pos")).agg(F.max("stop").alias("other"), F.lit(1).alias("rank"))
    both = by_stop.unionByName(by_start)
    return both.groupBy("contig_id", "pos").agg(F.max_by("other", "rank").alias("other"))


def deserts(orfs: DataFrame, contigs: DataFrame) -> DataFrame:
    """(contig_id, last, b): uncovered runs longer than NEAR, from the last covered position to the next one."""
    spans = orfs.select("contig_id", F.least("start", "stop").alias("a"), F.greatest("start", "stop").alias("z")).distinct().join(contigs.select("contig_id", "len"), "contig_id")
    spans = spans.select("contig_id", "a", F.least("z", F.col("len") - 1).alias("z"))
    before = Window.partitionBy("contig_id").orderBy("a", "z").rowsBetween(Window.unboundedPreceding, -1)
    gaps = spans.select("contig_id", F.coalesce(F.max("z").over(before), F.lit(0)).alias("last"), F.col("a").alias("b"))
    return gaps.where(F.col("b") - F.col("last") > NEAR)


def _edge(df: DataFrame, kind: str, src: str, dst: str, weight) -> DataFrame:
    """Edges of df, whose nodes are columns prefixed l_ and r_."""
    return df.select("contig_id", F.lit(kind).alias("kind"), *(F.col(f"{p}_{c}").alias(f"{n}_{c}") for n, p in (("src", src), ("dst", dst)) for c in ("pos", "type", "frame")), quantised(weight).alias("weight"))


def edges_orf(scored: DataFrame) -> DataFrame:
    ahead = F.col("frame") > 0
    start, stop = F.struct(F.col("start").alias("p"), F.lit("start").alias("t")), F.struct(F.col("stop").alias("p"), F.lit("stop").alias("t"))
    both = scored.withColumns({"s": F.when(ahead, start).otherwise(stop), "d": F.when(ahead, stop).otherwise(start)})
    return both.select("contig_id", F.lit("orf").alias("kind"), F.col("s.p").alias("src_pos"), F.col("s.t").alias("src_type"), F.col("frame").alias("src_frame"), F.col("d.p").alias("dst_pos"), F.col("d.t").alias("dst_type"), F.col("frame").alias("dst_frame"), quantised(F.col("weight")).alias("weight"))


def _sided(n: DataFrame, side: str) -> DataFrame:
    return n.select("contig_id", *(F.col(c).alias(f"{side}_{c}") for c in n.columns if c != "contig_id"))


def near_pairs(orfs: DataFrame, contigs: DataFrame) -> DataFrame:
    """Pairs of nodes with 0 < r - l < NEAR, each with its other end, stop probability and the contig's."""
    known = orfs.select("contig_id", F.col("stop").alias("pos"), F.col("start").alias("other"), F.col("pstop").alias("own")).groupBy("contig_id", "pos", "other").agg(F.max("own").alias("own"))
    n = nodes(orfs).join(other_end(orfs), ["contig_id", "pos"], "left").join(known, ["contig_id", "pos", "other"], "left").join(contig_pstop(contigs), "contig_id")
    n = n.select("contig_id", "pos", "type", "frame", "other", F.coalesce("own", "pstop").alias("o"), "pstop")
    left = _sided(n, "l").withColumn("block", F.explode(F.array(F.floor(F.col("l_pos") / NEAR), F.floor(F.col("l_pos") / NEAR) + 1)))
    right = _sided(n, "r").withColumn("block", F.floor(F.col("r_pos") / NEAR))
    pairs = left.join(right, ["contig_id", "block"])
    return pairs.where((F.col("l_pos") < F.col("r_pos")) & (F.col("r_pos") - F.col("l_pos") < NEAR)).drop("block")


def _is(side: str, kind: str, ahead: bool):
    return (F.col(f"{side}_type") == kind) & ((F.col(f"{side}_frame") > 0) if ahead else (F.col(f"{side}_frame") < 0))


def edges_near(pairs: DataFrame) -> DataFrame:
    """The four families of edges between near nodes, told apart in one pass over the pairs; overlaps lead back."""
    l, r, lo, ro = F.col("l_pos"), F.col("r_pos"), F.col("l_other"), F.col("r_other")
    kind = F.when((_is("l", "stop", True) & _is("r", "start", True)) | (_is("l", "start", False) & _is("r", "stop", False)), "gap_same")
    kind = kind.when(((_is("l", "start", True) & _is("r", "stop", True)) | (_is("l", "stop", False) & _is("r", "start", False))) & (F.col("l_frame") != F.col("r_frame")) & (r < lo) & (ro < l), "overlap_same")
    kind = kind.when((_is("l", "stop", True) & _is("r", "stop", False)) | (_is("l", "start", False) & _is("r", "start", True) & (r - l > 2)), "gap_diff")
    kind = kind.when((_is("l", "stop", False) & _is("r", "stop", True) & (ro + 3 < l) & (r < lo)) | (_is("l", "start", True) & _is("r", "start", False) & (ro < l) & (r < lo)), "overlap_diff")
    return _led(pairs.withColumn("kind", kind).where("kind is not null").withColumns({"mean": (F.col("l_o") + F.col("r_o")) / 2, "pstop": F.col("l_pstop")}))


def _led(told: DataFrame) -> DataFrame:
    """Edges between near nodes (columns prefixed l_ and r_) by their kind, the mean of their ORFs' stop probabilities and the
    contig's."""
    gap = F.col("r_pos") - F.col("l_pos") - 3
    lap = F.col("r_pos") - F.col("l_pos") + 3
    mean, pgap = F.col("mean"), F.col("pstop")
    cost = F.when(F.col("kind") == "gap_same", score_gap(gap, False, pgap)).when(F.col("kind") == "gap_diff", score_gap(gap, True, pgap)).when(F.col("kind") == "overlap_same", score_overlap(lap, False, mean)).otherwise(score_overlap(lap, True, mean))
    back = F.col("kind").startswith("overlap")
    end = lambda first, second, c: F.when(back, F.col(f"{second}_{c}")).otherwise(F.col(f"{first}_{c}"))
    return told.select("contig_id", "kind", *(end(*(("l", "r") if n == "src" else ("r", "l")), c).alias(f"{n}_{c}") for n in ("src", "dst") for c in ("pos", "type", "frame")), quantised(cost).alias("weight"))


def _spans_of(seq: bytes, table: int) -> tuple[np.ndarray, tuple[np.ndarray, ...]]:
    x = K.codes_of(seq)
    return x, K.orf_arrays(x, tuple(caller_starts(table)), tuple(stop_codons(table)), False, 90)


def _known(contigs: DataFrame) -> DataFrame:
    return contigs.where("contig_id is not null and len > 0").withColumn("pstop", genome_pstop(F.col("seq")))


def _type(is_start: str):
    return F.when(F.col(is_start), "start").otherwise("stop")


def near_edges_of(contigs: DataFrame, table: int = 11) -> DataFrame:
    """edges_near of all ORFs of contigs, without a shuffle; a task holds one contig's nodes and a part of its pairs. Each row of
    contigs is one of its own, also where rows share an id; rows without an id have no edges."""

    def found(seq: bytes, whole: float) -> Iterator[tuple[list, int]]:
        x, (start, stop, frame) = _spans_of(seq, table)
        if not len(start):
            return
        pstop, _ = K.span_pstop(K.base_sums(x), np.minimum(start, stop) - 1, np.maximum(start, stop) + 2, frame > 0)
        pos, is_start, side = K.ends_of(start, stop, frame)
        other = K.other_ends(start, stop, frame, pos)
        own = K.own_pstop(start, stop, pstop, pos, other, whole)
        for kind, l, r in K.near_pairs(pos, is_start, side, other, NEAR):
            yield [kind, (own[l] + own[r]) / 2, pos[l], is_start[l], side[l], pos[r], is_start[r], side[r]], len(kind)

    node = lambda p: [(f"{p}_pos", "int", pa.int32()), (f"{p}_start", "boolean", pa.bool_()), (f"{p}_frame", "int", pa.int32())]
    told = K.per_contig(_known(contigs), found, [("family", "int", pa.int32()), ("mean", "double", pa.float64()), *node("l"), *node("r")], "pstop", keep=("contig_id", "pstop"))
    kinds = F.array(*(F.lit(k) for k in ("gap_same", "overlap_same", "gap_diff", "overlap_diff")))
    return _led(told.withColumns({"kind": F.get(kinds, "family"), "l_type": _type("l_start"), "r_type": _type("r_start")}))


def terminal_edges_of(contigs: DataFrame, table: int = 11) -> DataFrame:
    """edges_terminal of all ORFs of contigs, without a shuffle; rows that share an id or have none as in `near_edges_of`."""

    def found(seq: bytes):
        pos, is_start, frame = K.ends_of(*_spans_of(seq, table)[1])
        inward, left = is_start == (frame > 0), len(seq) - pos
        first, last = np.flatnonzero(inward & (pos <= REACH)), np.flatnonzero(~inward & (left >= 0) & (left <= REACH))
        at = np.concatenate([first, last])
        return [np.arange(len(at)) >= len(first), pos[at], is_start[at], frame[at]], len(at)

    n = K.per_contig(_known(contigs), found, [("last", "boolean", pa.bool_()), ("pos", "int", pa.int32()), ("start", "boolean", pa.bool_()), ("frame", "int", pa.int32())], keep=("contig_id", "len", "pstop"))
    own, source, target = ([F.col("pos"), _type("start"), F.col("frame")], [F.lit(0), F.lit("source"), F.lit(0)], [F.col("len") + 1, F.lit("target"), F.lit(0)])
    ends = [F.when(F.col("last"), a).otherwise(b).alias(x) for a, b, x in zip([*own, *target], [*source, *own], EDGE[2:8], strict=True)]
    length = F.when(F.col("last"), F.col("len") - F.col("pos")).otherwise(F.col("pos"))
    return n.select("contig_id", F.when(F.col("last"), "target").otherwise("source").alias("kind"), *ends, quantised(score_gap(length, False, F.col("pstop"))).alias("weight"))


def _blocked(n: DataFrame, side: str) -> DataFrame:
    return _sided(n, side).withColumn("block", F.floor(F.col(f"{side}_pos") / NEAR))


def edges_desert(orfs: DataFrame, contigs: DataFrame) -> DataFrame:
    """Bridges over uncovered runs: nodes just before one with nodes just after it, found by blocks of positions."""
    n, d = nodes(orfs), deserts(orfs, contigs)
    blocks = lambda first, end: F.explode(F.sequence(F.floor(first / NEAR), F.floor(end / NEAR)))
    before = d.withColumn("block", blocks(F.greatest(F.col("last") - NEAR, F.lit(0)), F.col("last") + 1))
    left = before.join(_blocked(n, "l"), ["contig_id", "block"]).where((F.col("l_pos") > F.greatest(F.col("last") - NEAR, F.lit(0))) & (F.col("l_pos") <= F.col("last") + 1))
    after = left.withColumn("block", blocks(F.col("b") - 1, F.col("b") + NEAR))
    both = after.join(_blocked(n, "r"), ["contig_id", "block"]).where((F.col("r_pos") >= F.col("b") - 1) & (F.col("r_pos") < F.col("b") + NEAR)).join(contig_pstop(contigs), "contig_id")
    gap = F.col("r_pos") - F.col("l_pos") - 3
    same = both.where((_is("l", "stop", True) & _is("r", "start", True)) | (_is("l", "start", False) & _is("r", "stop", False)))
    diff = both.where((_is("l", "stop", True) & _is("r", "stop", False)) | (_is("l", "start", False) & _is("r", "start", True)))
    return _edge(same, "desert_same", "l", "r", score_gap(gap, False, F.col("pstop"))).unionByName(_edge(diff, "desert_diff", "l", "r", score_gap(gap, True, F.col("pstop"))))


def edges_terminal(orfs: DataFrame, contigs: DataFrame) -> DataFrame:
    """Edges from the source and to the target; both have frame 0."""
    n = nodes(orfs).join(contigs.select("contig_id", "len"), "contig_id").join(contig_pstop(contigs), "contig_id")
    first = n.where((F.col("pos") <= REACH) & (((F.col("type") == "start") & (F.col("frame") > 0)) | ((F.col("type") == "stop") & (F.col("frame") < 0))))
    last = n.where((F.col("len") - F.col("pos")).between(0, REACH) & (((F.col("type") == "start") & (F.col("frame") < 0)) | ((F.col("type") == "stop") & (F.col("frame") > 0))))
    own = [F.col("pos"), F.col("type"), F.col("frame")]
    end = lambda name, pos: [pos, F.lit(name), F.lit(0)]
    row = lambda df, kind, src, dst, length: df.select("contig_id", F.lit(kind).alias("kind"), *(c.alias(x) for c, x in zip([*src, *dst], EDGE[2:8], strict=True)), quantised(score_gap(length, False, F.col("pstop"))).alias("weight"))
    return row(first, "source", end("source", F.lit(0)), own, F.col("pos")).unionByName(row(last, "target", own, end("target", F.col("len") + 1), F.col("len") - F.col("pos")))


def edges(scored: DataFrame, contigs: DataFrame) -> DataFrame:
    """All families; parallel edges stay."""
    spans = scored.select("contig_id", "start", "stop", "frame", "pstop")
    families = [edges_orf(scored), edges_desert(spans, contigs), edges_near(near_pairs(spans, contigs)), edges_terminal(spans, contigs)]
    return reduce(DataFrame.unionByName, families)
