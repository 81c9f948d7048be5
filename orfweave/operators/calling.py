"""Gene calling of whole contigs in a map: ORFs, their weights, the graph, its cheapest path and the genes on it.

A contig's genes depend on nothing of another contig, so a task takes its contigs one after the other and nothing is shuffled
or stored. (As relations, near pairs and edges were shuffled several times and took many times their contigs' size.) The
relations of `scoring`, `graph` and `solver` state the same steps; tests hold both against each other. Each row of contigs is
one of its own, also where rows share an id; rows without an id have no genes. Memory follows the longest contig and its edges.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.codes import caller_starts, start_weights, stop_codons
from . import kernels as K
from .graph import NEAR, REACH
from .scoring import BINS
from .solver import ORDER, TYPES, cheapest

_PATH = [("step", "int", pa.int32())] + [(f"{s}_{n}", "string" if n == "type" else "int", pa.string() if n == "type" else pa.int32()) for s in ("src", "dst") for n in ("pos", "type", "frame")]
_GENE = [("step", "int", pa.int32()), ("start", "int", pa.int32()), ("stop", "int", pa.int32()), ("strand", "string", pa.string()), ("score", "double", pa.float64()), ("start_codon", "string", pa.string()), ("seq", "string", pa.string())]
_SCORED = [
    ("start", "int", pa.int32()), ("stop", "int", pa.int32()), ("frame", "int", pa.int32()), ("rbs_score", "int", pa.int32()), ("pstop", "double", pa.float64()),
    ("weight_rbs", "double", pa.float64()), ("ln_hold", "double", pa.float64()), ("ln_weight", "double", pa.float64()), ("weight", "double", pa.float64()), ("start_codon", "string", pa.string()),
]


@dataclass(frozen=True)
class Calling:
    """How genes are called."""

    table: int = 11
    closed_ends: bool = False
    mask_n: bool = False
    min_len: int = 90


class Scored(NamedTuple):
    """A contig's ORFs in order of emission, and base_sums of the contig."""

    start: np.ndarray
    stop: np.ndarray
    frame: np.ndarray
    rbs_score: np.ndarray
    pstop: np.ndarray
    weight_rbs: np.ndarray
    ln_hold: np.ndarray
    ln_weight: np.ndarray
    weight: np.ndarray
    sums: np.ndarray


class Graph(NamedTuple):
    """Nodes by position, then the source and the target; edges in their order for ties. An edge's orf is -1 if it is none."""

    pos: np.ndarray
    type: np.ndarray
    frame: np.ndarray
    src: np.ndarray
    dst: np.ndarray
    weight: np.ndarray
    orf: np.ndarray


@functools.cache
def _first_weights(table: int) -> tuple[np.ndarray, np.ndarray]:
    """Weights of start codons for each of TRIPLES as it is, and for its reverse complement."""
    weights, turned = start_weights(table), str.maketrans("acgtn", "tgcaa")
    return np.array([weights.get(t, 1.0) for t in K.TRIPLES]), np.array([weights.get(t[::-1].translate(turned), 1.0) for t in K.TRIPLES])


def _training(start: np.ndarray, stop: np.ndarray, frame: np.ndarray, atg: np.ndarray) -> tuple[np.ndarray, ...]:
    """The longest of the ORFs with start atg of each stop position."""
    start, stop, frame = start[atg], stop[atg], frame[atg]
    order = np.lexsort((frame, np.abs(start - stop), stop))
    best = order[K.lasts(stop[order])]
    return start[best], stop[best], frame[best]


def scored(x: np.ndarray, how: Calling) -> Scored | None:
    """A contig's ORFs with their weights; None if it has no ORF."""
    start, stop, frame = K.orf_arrays(x, tuple(caller_starts(how.table)), tuple(stop_codons(how.table)), how.closed_ends, how.min_len)
    if not len(start):
        return None
    sums = K.base_sums(x)
    pstop, masked = K.span_pstop(sums, np.minimum(start, stop) - 1, np.maximum(start, stop) + 2, frame > 0)
    if how.mask_n:
        start, stop, frame, pstop = (a[masked == 0] for a in (start, stop, frame, pstop))
        if not len(start):
            return None
    ahead = frame > 0
    score, seen = K.orf_and_position_scores(x, start, frame, BINS)
    odds = (np.bincount(score, minlength=BINS) + 1) / (len(start) + BINS) / ((seen + 1) / (2 * len(x) + BINS))
    codon = K.codons_of(x)[start - 1]
    atg = np.where(ahead, K.flags(("atg",))[codon], K.flags(("atg",), True)[codon])
    ranks = K.frame_ranks(x)
    most, least = K.bias_counts(ranks, *_training(start, stop, frame, atg))
    # Whole numbers over one divisor: the bias of frames is a count over the largest count.
    totals = K.pair_totals(ranks, start, stop, frame, np.outer(most, least).ravel()) / (int(most.max()) * int(least.max()))
    ahead_weights, back_weights = _first_weights(how.table)
    first, rbs = np.where(ahead, ahead_weights[codon], back_weights[codon]), odds[score]
    ln_hold = np.log(1 - pstop) * totals
    with np.errstate(over="ignore", divide="ignore"):
        weight = -(1 / np.exp(ln_hold)) * first * rbs
    return Scored(start, stop, frame, score, pstop, rbs, ln_hold, -ln_hold + np.log(first) + np.log(rbs), weight, sums)


def quantised(weight: np.ndarray) -> np.ndarray:
    """Thousandths, cut towards zero; what is not finite becomes 0."""
    with np.errstate(over="ignore"):
        w = weight * 1000.0
    return np.where(np.isfinite(w), np.trunc(w), 0.0)


def _genome_pstop(sums: np.ndarray, size: int) -> float:
    a, c, g, t, _ = (int(n) for n in sums[:, -1])
    at, gc = (a + t) / (2 * size), (c + g) / (2 * size)
    return at * at * at + at * gc * at + at * at * gc


def _deserts(o: Scored, size: int) -> list[tuple[int, int]]:
    """Uncovered runs longer than NEAR: the last covered position and the next one."""
    a, z = np.minimum(o.start, o.stop), np.minimum(np.maximum(o.start, o.stop), size - 1)
    order = np.lexsort((z, a))
    a = a[order]
    last = np.append(0, np.maximum.accumulate(z[order])[:-1])
    return [(int(last[i]), int(a[i])) for i in np.flatnonzero(a - last > NEAR)]


def graph_of(o: Scored, size: int) -> Graph | None:
    """The graph of a contig's ORFs; None if no edge leaves the source or none meets the target."""
    pos, is_start, frame = K.ends_of(o.start, o.stop, o.frame)
    inward, left = is_start == (frame > 0), size - pos
    first, last = np.flatnonzero(inward & (pos <= REACH)), np.flatnonzero(~inward & (left >= 0) & (left <= REACH))
    if not len(first) or not len(last):
        return None
    n, whole = len(pos), _genome_pstop(o.sums, size)
    other = K.other_ends(o.start, o.stop, o.frame, pos)
    own = K.own_pstop(o.start, o.stop, o.pstop, pos, other, whole)
    side, ahead, far = 2 * is_start + (frame > 0), o.frame > 0, pow(1 - whole, 100.0)
    # Costs of gaps of -3 ... 300 bases; longer ones cost their length.
    short = np.array([pow(1 - whole, -k / 3.0) for k in range(-3, 301)])

    def gap(length: np.ndarray, switch: np.ndarray | float) -> np.ndarray:
        return np.where(length > 300, far + length, short[np.minimum(length, 300) + 3] + switch)

    key = (2 * pos + is_start) * 8 + frame + 3
    a, z = (np.searchsorted(key, (2 * p + s) * 8 + o.frame + 3) for p, s in ((o.start, 1), (o.stop, 0)))
    parts = [(np.zeros(len(a), np.int64), np.where(ahead, a, z), np.where(ahead, z, a), o.weight)]
    for before, after in _deserts(o, size):
        l = np.arange(np.searchsorted(pos, max(before - NEAR, 0), "right"), np.searchsorted(pos, before + 1, "right"))
        r = np.arange(np.searchsorted(pos, after - 1, "left"), np.searchsorted(pos, after + NEAR, "left"))
        l, r = np.repeat(l, len(r)), np.tile(r, len(l))
        kind = K.FAMILY[side[l], side[r]]
        some = (kind == 0) | (kind == 2)
        l, r, kind = l[some], r[some], kind[some]
        parts.append((1 + kind.astype(np.int64) // 2, l, r, gap(pos[r] - pos[l] - 3, np.where(kind == 2, 20.0, 0.0))))
    for kind, l, r in K.near_pairs(pos, is_start, frame, other, NEAR):
        apart, switch, back = pos[r] - pos[l], np.where(kind >= 2, 20.0, 0.0), kind % 2 == 1
        cost = gap(apart - 3, switch)
        lap = np.flatnonzero(back)
        with np.errstate(over="ignore"):
            cost[lap] = np.power(1 - (own[l[lap]] + own[r[lap]]) / 2, -(apart[lap] + 3.0)) + switch[lap]
        parts.append((3 + kind.astype(np.int64), np.where(back, r, l), np.where(back, l, r), cost))
    parts.append((np.full(len(first), 7), np.full(len(first), n), first, gap(pos[first], 0.0)))
    parts.append((np.full(len(last), 8), last, np.full(len(last), n + 1), gap(left[last], 0.0)))
    rank, src, dst, cost = (np.concatenate(p) for p in zip(*parts, strict=True))
    pos, frame = np.append(pos, [0, size + 1]), np.append(frame, [0, 0])
    kind = np.append(np.where(is_start, 0, 1), [2, 3])
    order = np.lexsort((((pos[dst] * 7 + frame[src] + 3) * 7 + frame[dst] + 3) * 4 + kind[src], rank << 40 | pos[src]))
    orf = np.where(rank == ORDER.index("orf"), np.arange(len(rank)), -1)
    return Graph(pos, kind, frame, src[order], dst[order], quantised(cost)[order], orf[order])


def path_of(o: Scored | None, size: int) -> tuple[Graph, np.ndarray] | None:
    """A contig's graph and the edges of its cheapest path, in their order."""
    g = graph_of(o, size) if o else None
    edges = cheapest(g.src, g.dst, g.weight, len(g.pos), len(g.pos) - 2, len(g.pos) - 1) if g else None
    return (g, np.array(edges)) if edges else None


def _genes(seq: bytes, o: Scored | None, with_seq: bool) -> list[list]:
    """Columns of _GENE of the genes on a contig's path, with coordinates as printed: reverse genes have start above stop."""
    path = path_of(o, len(seq))
    if not path:
        return [[] for _ in _GENE]
    orf = path[0].orf[path[1]]
    step = np.flatnonzero(orf >= 0)
    orf = orf[step]
    ahead, turned, size = o.frame[orf] > 0, K.reverse_complement(seq), len(seq)
    start, stop = np.where(ahead, o.start[orf], o.start[orf] + 2).tolist(), np.where(ahead, o.stop[orf] + 2, o.stop[orf]).tolist()
    # The first base of a gene is its start, on either strand.
    cuts = [(seq, a - 1, b) if f else (turned, size - a, size - b + 1) for a, b, f in zip(start, stop, ahead.tolist(), strict=True)]
    bases = [s[a:b].decode() for s, a, b in cuts] if with_seq else [None] * len(cuts)
    return [step.tolist(), start, stop, ["+" if f else "-" for f in ahead.tolist()], o.weight[orf].tolist(), [s[a : a + 3].decode() for s, a, _ in cuts], bases]


def _known(contigs: DataFrame) -> DataFrame:
    return contigs.where("contig_id is not null")


def scored_of(contigs: DataFrame, how: Calling = Calling()) -> DataFrame:
    """ORFs with what their weights are made of, and their weights, infinite where those exceed a double."""

    def found(seq: bytes):
        o = scored(K.codes_of(seq), how)
        if o is None:
            return None
        turned, size = K.reverse_complement(seq), len(seq)
        starts = [seq[a - 1 : a + 2].decode() if f > 0 else turned[size - a - 2 : size - a + 1].decode() for a, f in zip(o.start.tolist(), o.frame.tolist(), strict=True)]
        return [*o[:9], starts], len(o.start)

    return K.per_contig(_known(contigs), found, _SCORED)


def paths_of(contigs: DataFrame, how: Calling = Calling()) -> DataFrame:
    """The cheapest path of each contig, a row for each of its edges."""

    def found(seq: bytes):
        path = path_of(scored(K.codes_of(seq), how), len(seq))
        if not path:
            return None
        g, edges = path
        ends = [column for e in (g.src[edges], g.dst[edges]) for column in (g.pos[e], [TYPES[t] for t in g.type[e].tolist()], g.frame[e])]
        return [np.arange(len(edges)), *ends], len(edges)

    return K.per_contig(_known(contigs), found, _PATH)


def genes_of(contigs: DataFrame, how: Calling = Calling()) -> DataFrame:
    """Genes of each contig, a row for each."""

    def found(seq: bytes):
        columns = _genes(seq, scored(K.codes_of(seq), how), True)
        return columns, len(columns[0])

    return K.per_contig(_known(contigs), found, _GENE)


def called(contigs: DataFrame, how: Calling = Calling(), with_seq: bool = True) -> DataFrame:
    """contigs (contig_id, seq, len) with n_orfs and genes, an array of a contig's genes by step; all rows stay."""

    def found(seq: bytes):
        o = scored(K.codes_of(seq), how)
        return [np.array([len(o.start) if o else 0]), *([c] for c in _genes(seq, o, with_seq))], 1

    arrays = [(n, f"array<{sql}>", pa.list_(kind)) for n, sql, kind in _GENE]
    out = K.per_contig(contigs, found, [("n_orfs", "int", pa.int32()), *((f"g_{n}", s, k) for n, s, k in arrays)], keep=("contig_id", "seq", "len"))
    zipped = F.arrays_zip(*(F.col(f"g_{n}").alias(n) for n, _, _ in _GENE))
    return out.select("contig_id", "seq", "len", "n_orfs", zipped.alias("genes"))
