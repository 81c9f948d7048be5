"""Open reading frames and open regions, found by a scan of each contig: one map over contigs, nothing is shuffled."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ..functions.codes import caller_starts, start_codons, stop_codons
from . import kernels as K

_SPAN = [("start", "int", pa.int32()), ("stop", "int", pa.int32()), ("frame", "int", pa.int32())]
_FACTS = [("start_codon", "string", pa.string()), ("rbs_score", "int", pa.int32()), ("pstop", "double", pa.float64()), ("emit_ord", "int", pa.int32())]
_REGION = [("table", "int", pa.int32()), ("strand", "string", pa.string()), ("frame", "int", pa.int32()), ("region_start", "int", pa.int32()), ("region_end", "int", pa.int32())]


def _sets(table: int, starts: str) -> tuple[tuple[str, ...], tuple[str, ...]]:
    return tuple(caller_starts(table) if starts == "caller" else start_codons(table)), tuple(stop_codons(table))


def orf_spans(contigs: DataFrame, table: int = 11, closed_ends: bool = False, min_len: int = 90, starts: str = "caller") -> DataFrame:
    """(contig_id, start, stop, frame) of all ORFs, nested ones included; contigs under 3 bases have none."""
    begin, end = _sets(table, starts)

    def found(seq: bytes):
        spans = K.orf_arrays(K.codes_of(seq), begin, end, closed_ends, min_len)
        return list(spans), len(spans[0])

    return K.per_contig(contigs, found, _SPAN)


def orfs(contigs: DataFrame, table: int = 11, closed_ends: bool = False, mask_n: bool = False, min_len: int = 90, starts: str = "caller", with_seq: bool = True) -> DataFrame:
    """ORFs with start_codon, rbs_score, pstop, emit_ord (their order of emission), len (the contig's) and, unless with_seq
    is off, seq; mask_n drops those that touch an n."""
    begin, end = _sets(table, starts)

    def found(seq: bytes):
        x = K.codes_of(seq)
        start, stop, frame = K.orf_arrays(x, begin, end, closed_ends, min_len)
        low, high = np.minimum(start, stop) - 1, np.maximum(start, stop) + 2
        if not len(start):
            return None
        pstop, masked = K.span_pstop(K.base_sums(x), low, high, frame > 0)
        score = K.orf_scores(x, start, frame).astype(np.int32)
        order = np.arange(len(start))
        if mask_n:
            fine = masked == 0
            start, stop, frame, low, high, pstop, score, order = (a[fine] for a in (start, stop, frame, low, high, pstop, score, order))
        turned, size = K.reverse_complement(seq), len(seq)
        cuts = [(seq, a, b) if f > 0 else (turned, size - b, size - a) for a, b, f in zip(low.tolist(), high.tolist(), frame.tolist(), strict=True)]
        columns = [start, stop, frame, [s[a : a + 3].decode() for s, a, _ in cuts], score, pstop, order, np.full(len(start), size)]
        return columns + ([[s[a:b].decode() for s, a, b in cuts]] if with_seq else []), len(start)

    more = [("len", "int", pa.int32())] + ([("seq", "string", pa.string())] if with_seq else [])
    return K.per_contig(contigs, found, _SPAN + _FACTS + more)


def open_regions(contigs: DataFrame, table: int | tuple[int, ...], min_len: int = 90, both_strands: bool = True) -> DataFrame:
    """(contig_id, strand, frame, region_start, region_end): stop-to-stop regions, 0-based, the end exclusive.

    With several tables one pass finds the regions of all of them, told apart by the column `table`.
    """
    tables = (table,) if isinstance(table, int) else tuple(table)
    ends = {t: tuple(stop_codons(t)) for t in tables}

    def found(seq: bytes):
        x = K.codes_of(seq)
        parts = []
        for strand in "+-" if both_strands else "+":
            # In detection the complement of n is n.
            y = x if strand == "+" else np.where(x < 4, 3 - x, 4).astype(np.uint8)[::-1]
            codons = K.codons_of(y) if len(y) >= 3 else y[:0]
            for t in tables:
                frame, start, end = K.regions_of(codons, len(x), K.flags(ends[t]), min_len)
                parts.append((np.full(len(frame), t), [strand] * len(frame), frame, start, end))
        return [np.concatenate([p[i] for p in parts]) if i != 1 else sum((p[1] for p in parts), []) for i in range(5)], sum(len(p[2]) for p in parts)

    out = K.per_contig(contigs, found, _REGION)
    return out.drop("table") if isinstance(table, int) else out
