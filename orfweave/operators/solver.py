"""Shortest paths, one contig per group: the one step that runs in Python.

Costs are whole numbers. They are kept as 64-bit integers where no path can overflow, and as Python integers otherwise.
A round relaxes all edges at once; a predecessor walk is bounded, so a negative cycle raises instead of looping.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K

PATH = "contig_id {id}, step int, src_pos int, src_type string, src_frame int, dst_pos int, dst_type string, dst_frame int"
#: Fixed order of families, for ties.
ORDER = ("orf", "desert_same", "desert_diff", "gap_same", "overlap_same", "gap_diff", "overlap_diff", "source", "target")


TYPES = ("start", "stop", "source", "target")


def cheapest(src: np.ndarray, dst: np.ndarray, weight: np.ndarray, n: int, source: int, target: int) -> list[int] | None:
    """Edges of a cheapest path, or None; edges are tried in their order, and only a lower cost replaces another. weight:
    whole numbers, also as doubles or Python integers. A round tries the edges of those nodes alone whose cost the last round
    lowered; others have been tried at their cost."""
    exact = weight.dtype == object
    big = sum(map(abs, weight.tolist())) >= 1 << 61 if exact else float(np.abs(weight).sum(dtype=np.float64)) >= 2.0**60
    w = np.array([int(v) for v in weight.tolist()], dtype=object) if big else weight.astype(np.int64)
    far = (1 << 4000) if big else np.iinfo(np.int64).max // 2
    cost = np.full(n, far, dtype=object if big else np.int64)
    cost[source] = 0
    back = np.full(n, -1)
    leaving = np.argsort(src, kind="stable")
    begin = np.searchsorted(src[leaving], np.arange(n + 1))
    many, lowered = begin[1:] - begin[:-1], np.array([source])
    for _ in range(n):
        each = many[lowered]
        ends = each.cumsum()
        if not ends[-1]:
            break
        edge = leaving[np.arange(ends[-1]) + (begin[lowered] - ends + each).repeat(each)]
        to, tried = dst[edge], cost[lowered].repeat(each) + w[edge]
        better = (tried < cost[to]).nonzero()[0]
        if not len(better):
            break
        edge, to, tried = edge[better], to[better], tried[better]
        # Of the improving edges into a node the cheapest wins, the first of equals.
        np.minimum.at(cost, to, tried)
        least = (tried == cost[to]).nonzero()[0]
        edge, to = edge[least], to[least]
        back[to] = len(src)
        np.minimum.at(back, to, edge)
        to.sort()
        lowered = to[K.lasts(to)]
    if back[target] < 0:
        return None
    path, at = [], target
    while at != source:
        path.append(int(back[at]))
        at = int(src[path[-1]])
        if len(path) >= n:
            raise ValueError("negative cycle")
    return path[::-1]


def shortest_path(src: np.ndarray, dst: np.ndarray, weight: list[int], n: int, source: int, target: int) -> list[int] | None:
    """Nodes of a cheapest path, or None, for costs as Python integers."""
    if source == target:
        return [source]
    path = cheapest(src, dst, np.array(weight, dtype=object), n, source, target)
    return None if path is None else [source, *(int(dst[e]) for e in path)]


def solve(table: pa.Table) -> pa.Table:
    """The path of one contig's edges, a row for each of its edges."""
    numbers = {c: table[c].to_numpy().astype(np.int64) for c in ("src_pos", "src_frame", "dst_pos", "dst_frame")}
    rank = pc.index_in(table["kind"], pa.array(ORDER)).to_numpy()
    types = {s: pc.index_in(table[f"{s}_type"], pa.array(TYPES)).to_numpy().astype(np.int64) for s in ("src", "dst")}
    order = np.lexsort((types["src"], numbers["dst_frame"], numbers["src_frame"], numbers["dst_pos"], numbers["src_pos"], rank))
    # A node is one number: its position, type and frame.
    code = lambda s: ((numbers[f"{s}_pos"] * len(TYPES) + types[s]) * 7 + numbers[f"{s}_frame"] + 3)[order]
    names, number = np.unique(np.concatenate([code("src"), code("dst")]), return_inverse=True)
    kinds = names // 7 % len(TYPES)
    ends = [np.flatnonzero(kinds == TYPES.index(k)) for k in ("source", "target")]
    path = None
    if all(map(len, ends)):
        n = len(order)
        weight = [int(w) for w in table["weight"].to_numpy()[order].tolist()]
        path = shortest_path(number[:n], number[n:], weight, len(names), int(ends[0][0]), int(ends[1][0]))
    steps = names[path] if path else names[:0]
    place = {"pos": steps // 7 // len(TYPES), "type": np.array(TYPES)[steps // 7 % len(TYPES)], "frame": steps % 7 - 3}
    columns = {"contig_id": table["contig_id"].combine_chunks().take(pa.array(np.zeros(max(len(steps) - 1, 0), np.int64))), "step": pa.array(np.arange(max(len(steps) - 1, 0)), pa.int32())}
    for s, part in (("src", slice(None, -1)), ("dst", slice(1, None))):
        for name, value in place.items():
            columns[f"{s}_{name}"] = pa.array(value[part].tolist(), pa.string() if name == "type" else pa.int32())
    return pa.table(columns)


def paths(edges: DataFrame) -> DataFrame:
    """The cheapest path of each contig. A contig's edges meet in one task: some 30 rows for each 100 bases' worth of ORFs,
    which suits genomes of up to some ten million bases."""
    kind = edges.schema["contig_id"].dataType.simpleString()
    return edges.groupBy("contig_id").applyInArrow(solve, PATH.format(id=kind))


def genes(path: DataFrame, scored: DataFrame) -> DataFrame:
    """Path edges that are ORFs, with coordinates as printed: reverse genes have start above stop."""
    cds = path.where("src_frame = dst_frame and src_frame <> 0 and ((src_frame > 0 and src_type = 'start' and dst_type = 'stop') or (src_frame < 0 and src_type = 'stop' and dst_type = 'start'))")
    ahead = F.col("src_frame") > 0
    keyed = cds.select("contig_id", "step", F.when(ahead, F.col("src_pos")).otherwise(F.col("dst_pos")).alias("start"), F.when(ahead, F.col("dst_pos")).otherwise(F.col("src_pos")).alias("stop"), F.col("src_frame").alias("frame"))
    found = keyed.join(scored, ["contig_id", "start", "stop", "frame"])
    ahead = F.col("frame") > 0
    start, stop = F.when(ahead, F.col("start")).otherwise(F.col("start") + 2), F.when(ahead, F.col("stop") + 2).otherwise(F.col("stop"))
    return found.select("contig_id", "step", start.alias("start"), stop.alias("stop"), F.when(ahead, "+").otherwise("-").alias("strand"), F.col("weight").alias("score"), "start_codon")


def with_sequences(found: DataFrame, contigs: DataFrame) -> DataFrame:
    """Genes with seq, cut out of their contigs; a contig meets all its genes at once."""
    names = [c for c in found.columns if c != "contig_id"]
    rows = found.groupBy("contig_id").agg(F.collect_list(F.struct(*names)).alias("rows"))
    both = contigs.select("contig_id", "seq").join(rows, "contig_id").select("contig_id", "seq", "rows", F.col("rows.start").alias("start"), F.col("rows.stop").alias("stop"))

    def cut(seq: bytes, start: np.ndarray, stop: np.ndarray):
        turned, size = K.reverse_complement(seq), len(seq)
        # Printed coordinates: the first base of a gene is its start, on either strand.
        return [[[(seq[a - 1 : b] if a <= b else turned[size - a : size - b + 1]).decode() for a, b in zip(start.tolist(), stop.tolist(), strict=True)]]], 1

    out = K.per_contig(both, cut, [("seqs", "array<string>", pa.list_(pa.string()))], "start", "stop", keep=("contig_id", "rows"))
    out = out.select("contig_id", F.explode(F.arrays_zip("rows", "seqs")).alias("z"))
    return out.select("contig_id", *(F.col(f"z.rows.{c}").alias(c) for c in names), F.col("z.seqs").alias("seq"))
