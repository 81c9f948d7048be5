"""Scans over the positions of a contig, as array kernels over Arrow batches.

A scan needs each base with its neighbours and nothing of another contig, so it is a map: a task reads its contigs once and
nothing is shuffled. (As rows per base the same scans took several times longer and a shuffle each.) Contigs arrive as
lower-case strings over a, c, g, t, n. Memory follows the longest contig: about 60 bytes for each of its bases.
"""

from __future__ import annotations

import functools
import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ..functions.seq import RBS_RULES

LETTERS = "acgtn"
TRIPLES = ["".join(x) for x in itertools.product(LETTERS, repeat=3)]
_CODE = np.full(256, 4, np.uint8)
for _i, _c in enumerate(b"acgt"):
    _CODE[_c] = _i
#: Complements of codes; in gene calling the complement of n is a.
_COMPLEMENT = np.array([3, 2, 1, 0, 0], np.uint8)
_REVERSED = bytes.maketrans(b"acgtn", b"tgcaa")
#: Rows and bytes of an output batch before it is handed over.
ROWS, BYTES = 50_000, 1 << 24


def codes_of(seq: bytes) -> np.ndarray:
    return _CODE[np.frombuffer(seq, np.uint8)]


def codons_of(x: np.ndarray) -> np.ndarray:
    """Numbers of the codons (places in TRIPLES) that begin at each position but the last two."""
    return x[:-2] * np.uint8(25) + x[1:-1] * np.uint8(5) + x[2:]


@functools.lru_cache(maxsize=64)
def flags(codons: tuple[str, ...], reverse: bool = False, keep_n: bool = False) -> np.ndarray:
    """For each of TRIPLES whether it, or its reverse complement, is among codons."""
    turned = str.maketrans("acgtn", "tgcan" if keep_n else "tgcaa")
    return np.array([(t[::-1].translate(turned) if reverse else t) in codons for t in TRIPLES])


def by_frame(codons: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codons and their positions as rows of three frames; places past the end hold the codon nnn."""
    rows = -(-len(codons) // 3)
    padded = np.full(3 * rows, 124, np.uint8)
    padded[: len(codons)] = codons
    return padded.reshape(rows, 3), np.arange(3 * rows).reshape(rows, 3)


def orf_arrays(x: np.ndarray, begin: tuple[str, ...], end: tuple[str, ...], closed: bool, min_len: int) -> tuple[np.ndarray, ...]:
    """(start, stop, frame) of all ORFs, 1-based, in order of emission: by the stop that ends a group, forward groups from
    the nearest start, reverse groups from the first; then what the contig's ends cut off, by frame, forward first."""
    size, none = len(x), np.zeros(0, np.int64)
    if size < 3:
        return none, none, none
    grid, pos = by_frame(codons_of(x))
    real, far = pos < size - 2, 4 * size
    last = (size - (size - np.arange(3)) % 3)[None, :]
    stops, turned_stops = flags(end)[grid], flags(end, True)[grid]
    after = np.minimum.accumulate(np.where(stops, pos, far)[::-1], axis=0)[::-1]
    before = np.maximum.accumulate(np.where(turned_stops, pos, -1), axis=0)
    later = np.minimum.accumulate(np.where(turned_stops, pos, far)[::-1], axis=0)[::-1]
    last_turned = np.where(turned_stops, pos, -1).max(axis=0)[None, :]
    frames = np.broadcast_to(np.arange(1, 4), pos.shape)

    first = real & (flags(begin)[grid] | (not closed and pos < 3)) & ((after < far) | (not closed))
    a, stop_a, frame_a, flush_a = pos[first] + 1, np.where(after < far, after + 1, last - 2)[first], frames[first], after[first]
    fine = stop_a + 3 - a >= min_len
    a, stop_a, frame_a, flush_a = a[fine], stop_a[fine], frame_a[fine], flush_a[fine]

    cut = (pos + 1 > size - 5) & (pos + 3 == last)
    second = real & (flags(begin, True)[grid] | ((not closed) & cut)) & ((last_turned > pos) | (not closed))
    b, stop_b, frame_b, flush_b = pos[second] + 1, np.where(before >= 0, before + 1, frames)[second], frames[second], later[second]
    flush_b = np.where(last_turned.ravel()[frame_b - 1] > b - 1, flush_b, far)
    fine = b + 3 - stop_b >= min_len
    b, stop_b, frame_b, flush_b = b[fine], stop_b[fine], frame_b[fine], flush_b[fine]

    flush = np.concatenate([flush_a, flush_b])
    strand = np.concatenate([np.zeros(len(a), np.int64), np.ones(len(b), np.int64)])
    frame = np.concatenate([frame_a, frame_b])
    order = np.lexsort((np.concatenate([-a, b]), strand, np.where(flush == far, frame, 0), flush))
    return np.concatenate([a, b])[order], np.concatenate([stop_a, stop_b])[order], np.where(strand == 0, frame, -frame)[order]


@functools.cache
def _motif_tables() -> list[tuple[int, int, np.ndarray]]:
    """For each range of offsets: the best score of a motif that a string of six bases begins with."""
    out = []
    for low, high in sorted({(a, b) for _, _, a, b in RBS_RULES}):
        best: dict[str, int] = {}
        for score, motifs, a, b in RBS_RULES:
            if (a, b) == (low, high):
                for m in motifs:
                    best[m] = max(score, best.get(m, 0))
        table = np.zeros((5,) * 6, np.uint8)
        for m, score in best.items():
            spot = tuple(LETTERS.index(c) for c in m)
            table[spot] = np.maximum(table[spot], score)
        out.append((low, high, table.ravel()))
    return out


def window_scores(back: np.ndarray, count: int) -> np.ndarray:
    """RBS scores of the windows of up to 21 bases that begin at the first `count` positions of back, read as they lie."""
    padded = np.concatenate([back, np.full(27, 4, np.uint8)]).astype(np.uint16)
    six = padded[:-5].copy()
    for k in range(1, 6):
        six = six * np.uint16(5) + padded[k : len(padded) - 5 + k]
    out = np.zeros(count, np.uint8)
    for low, high, table in _motif_tables():
        level = table[six]
        for o in range(low, high + 1):
            np.maximum(out, level[o : o + count], out=out)
    return out


def short_scores(back: np.ndarray) -> np.ndarray:
    """RBS scores of the first 1, 2, ... len(back) bases of back (at most 20), laid out with room between them."""
    grid = np.full((len(back), 27), 4, np.uint8)
    for n in range(len(back)):
        grid[n, : n + 1] = back[: n + 1]
    return window_scores(grid.ravel(), grid.size)[::27]


def position_scores(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """RBS scores of the (up to) 21 bases from each position: as they are, and as their reverse complement."""
    back = x[::-1]
    whole = window_scores(back, max(len(x) - 20, 0))[::-1]
    return np.concatenate([whole, short_scores(back[:20])[::-1]]), window_scores(_COMPLEMENT[x], len(x))


def orf_scores(x: np.ndarray, start: np.ndarray, frame: np.ndarray) -> np.ndarray:
    """RBS scores upstream of ORFs: 21 bases up to a forward start (a where the contig has none), 21 beyond a reverse codon."""
    size = len(x)
    ahead = window_scores(np.concatenate([x[::-1], np.zeros(20, np.uint8)]), size)
    back = np.concatenate([window_scores(_COMPLEMENT[x], size), np.zeros(3, np.uint8)])
    return np.where(frame > 0, ahead[size - start], back[np.minimum(start + 2, size)])


def orf_and_position_scores(x: np.ndarray, start: np.ndarray, frame: np.ndarray, bins: int) -> tuple[np.ndarray, np.ndarray]:
    """orf_scores, and how many positions have each of position_scores on either strand; windows are scored once for both."""
    size, back = len(x), x[::-1]
    ahead, turned = window_scores(np.concatenate([back, np.zeros(20, np.uint8)]), size), window_scores(_COMPLEMENT[x], size)
    seen = np.bincount(np.concatenate([ahead[: max(size - 20, 0)], short_scores(back[:20]), turned]), minlength=bins)
    return np.where(frame > 0, ahead[size - start], np.append(turned, np.zeros(3, np.uint8))[np.minimum(start + 2, size)]), seen


def base_sums(x: np.ndarray) -> np.ndarray:
    """Counts of a, c, g, t, n before each position and the end."""
    out = np.zeros((5, len(x) + 1), np.int32)
    for i in range(5):
        np.cumsum(x == i, out=out[i, 1:])
    return out


def span_pstop(sums: np.ndarray, low: np.ndarray, high: np.ndarray, ahead: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Stop probabilities of spans by their own composition, and how many n they hold."""
    a, c, g, t, n = (s[high] - s[low] for s in sums)
    size = (high - low).astype(np.float64)
    pa_, pt, pg = np.where(ahead, a, t + n) / size, np.where(ahead, t, a) / size, np.where(ahead, g, c) / size
    return pt * pa_ * pa_ + pt * pg * pa_ + pt * pa_ * pg, n


def gc_counts(x: np.ndarray) -> np.ndarray:
    """G or C among the 40 bases of a position's own frame around it, for each position."""
    rows = -(-len(x) // 3)
    grid = np.zeros((rows + 40, 3), np.int32)
    inner = np.zeros(3 * rows, np.int32)
    inner[: len(x)] = (x == 1) | (x == 2)
    grid[20 : 20 + rows] = inner.reshape(rows, 3)
    sums = np.concatenate([np.zeros((1, 3), np.int32), np.cumsum(grid, axis=0, dtype=np.int32)])
    return (sums[41 : 41 + rows] - sums[1 : 1 + rows]).ravel()[: len(x)]


def largest(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.where((a > b) & (a > c), 1, np.where(b > c, 2, 3))


def smallest(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.where((a > b) & (b > c), 3, np.where(a > b, 2, np.where(a > c, 3, 1)))


def frame_ranks(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each position but the last two the pair (frame with most, frame with least G and C) as 3 hi + lo - 4, read
    forwards and backwards."""
    t = gc_counts(x)
    one, two, three = t[:-2], t[1:-1], t[2:]
    pair = lambda a, b, c: (3 * largest(a, b, c) + smallest(a, b, c) - 4).astype(np.int8)
    return pair(one, two, three), pair(three, two, one)


def pair_counts(x: np.ndarray, start: np.ndarray, stop: np.ndarray, frame: np.ndarray) -> np.ndarray:
    """For each ORF how many of its codons have each of the nine pairs of `frame_ranks`: (ORFs, 9)."""
    ranks = frame_ranks(x)
    rows = -(-len(x) // 3) + 2
    ahead = frame > 0
    # Codons of forward ORFs begin at start ... stop - 3, of reverse ones (leftmost base) at stop + 3 ... start.
    low, high = np.where(ahead, start, stop + 3) - 1, np.where(ahead, stop, start + 3) - 1
    out = np.zeros((len(start), 9), np.int64)
    for strand, rank in ((True, ranks[0]), (False, ranks[1])):
        some = np.flatnonzero((ahead == strand) & (high > low))
        if not len(some):
            continue
        padded = np.full(3 * rows, -1, np.int8)
        padded[: len(rank)] = rank
        grid = padded.reshape(rows, 3)
        f, first, last = low[some] % 3, low[some] // 3, high[some] // 3
        for k in range(9):
            sums = np.concatenate([np.zeros((1, 3), np.int32), np.cumsum(grid == k, axis=0, dtype=np.int32)])
            out[some, k] = sums[last, f] - sums[first, f]
    return out


def _codon_range(start: np.ndarray, stop: np.ndarray, ahead: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """0-based leftmost bases of an ORF's first codon and of the one behind its last, as in `pair_counts`."""
    return np.where(ahead, start, stop + 3) - 1, np.where(ahead, stop, start + 3) - 1


def bias_counts(ranks: tuple[np.ndarray, np.ndarray], start: np.ndarray, stop: np.ndarray, frame: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How often each frame has most and least G and C in training ORFs, whose first eighths and last 12 codons are left out;
    one pseudocount each."""
    pairs, ahead, skip = np.zeros(9), frame > 0, np.abs(stop - start) // 8 * 3
    first = np.where(ahead, start + skip, start - skip)
    last = np.where(ahead, first + ((stop - 37 - first) // 3 + 1) * 3, first - ((first - (stop + 37)) // 3 + 1) * 3)
    low, high = _codon_range(first, last, ahead)
    for strand, rank in ((True, ranks[0]), (False, ranks[1])):
        some = (ahead == strand) & (high > low)
        if some.any():
            # Codons lie three apart: how many ORFs hold each is a running sum by frame.
            size = 3 * (len(rank) // 3 + 2)
            inside = (np.bincount(low[some], minlength=size) - np.bincount(high[some], minlength=size)).reshape(-1, 3).cumsum(0).ravel()
            pairs += np.bincount(rank, inside[: len(rank)], 9)
    counts = pairs.astype(np.int64).reshape(3, 3)
    return counts.sum(1) + 1, counts.sum(0) + 1


def pair_totals(ranks: tuple[np.ndarray, np.ndarray], start: np.ndarray, stop: np.ndarray, frame: np.ndarray, value: np.ndarray) -> np.ndarray:
    """For each ORF the sum over its codons of the whole numbers that value has for the nine pairs of `frame_ranks`. The
    running sums may pass 64 bits and wrap around; an ORF's own sum, their difference, doesn't."""
    ahead = frame > 0
    low, high = _codon_range(start, stop, ahead)
    out = np.zeros(len(start), np.int64)
    for strand, rank in ((True, ranks[0]), (False, ranks[1])):
        some = np.flatnonzero((ahead == strand) & (high > low))
        if len(some):
            sums = np.zeros((len(rank) // 3 + 3, 3), np.int64)
            flat = sums.reshape(-1)
            flat[3 : 3 + len(rank)] = value[rank]
            np.cumsum(sums, axis=0, out=sums)
            out[some] = flat[high[some]] - flat[low[some]]
    return out


def ends_of(start: np.ndarray, stop: np.ndarray, frame: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(position, whether it is a start, frame) of the distinct ends of ORFs, by position."""
    key = np.unique(np.concatenate([2 * start + 1, 2 * stop]) * 8 + np.concatenate([frame, frame]) + 3)
    return key >> 4, key >> 3 & 1 == 1, (key & 7) - 3


def lasts(x: np.ndarray) -> np.ndarray:
    """Places of the last of each run of equals."""
    last = np.ones(len(x), bool)
    np.not_equal(x[1:], x[:-1], out=last[:-1])
    return last.nonzero()[0]


def _looked_up(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray, otherwise: np.ndarray | float) -> np.ndarray:
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, values[at], otherwise)


def other_ends(start: np.ndarray, stop: np.ndarray, frame: np.ndarray, pos: np.ndarray) -> np.ndarray:
    """For each of pos the farthest start of a stop, the stop of a start; a start's entry wins a collision."""
    order = np.lexsort((start, stop))
    a, z = start[order], stop[order]
    last = lasts(z)
    first = np.append(0, last[:-1] + 1)
    far = np.where(np.maximum.reduceat(frame[order], first) > 0, a[first], a[last])
    order = np.lexsort((stop, start))
    ends = order[lasts(start[order])]
    return _looked_up(start[ends], stop[ends], pos, _looked_up(z[last], far, pos, 0))


def own_pstop(start: np.ndarray, stop: np.ndarray, pstop: np.ndarray, pos: np.ndarray, other: np.ndarray, whole: float) -> np.ndarray:
    """Stop probabilities of the ORFs that lead from other to the stop pos (the largest); the contig's where there is none."""
    key = stop << 32 | start
    order = np.lexsort((pstop, key))
    last = order[lasts(key[order])]
    return _looked_up(key[last], pstop[last], pos << 32 | other, whole)


#: Number of the family of edges from a left to a right node, each 2 * (it is a start) + (its frame is forward): gap and overlap
#: on one strand (0, 1) and on both (2, 3).
FAMILY = np.full((4, 4), -1, np.int8)
for _l, _r, _k in ((1, 3, 0), (2, 0, 0), (3, 1, 1), (0, 2, 1), (1, 0, 2), (2, 3, 2), (0, 1, 3), (3, 2, 3)):
    FAMILY[_l, _r] = _k


def near_pairs(pos: np.ndarray, is_start: np.ndarray, frame: np.ndarray, other: np.ndarray, near: int, most: int = 1 << 18) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(family, left, right) of the pairs of nodes (numbered by position) with 0 < right - left < near that make an edge, in
    parts of about `most` pairs looked at, so memory doesn't follow their number."""
    first, end = np.searchsorted(pos, pos, "right"), np.searchsorted(pos, pos + near, "left")
    total = np.append(0, np.cumsum(end - first))
    side, begin = 2 * is_start + (frame > 0), 0
    while begin < len(pos):
        until = max(begin + 1, int(np.searchsorted(total, total[begin] + most, "right")) - 1)
        left = np.repeat(np.arange(begin, until), (end - first)[begin:until])
        right = np.arange(len(left)) + total[begin] - total[left] + first[left]
        kind = FAMILY[side[left], side[right]]
        some = np.flatnonzero(kind >= 0)
        kind, left, right, begin = kind[some], left[some], right[some], until
        l, r, lo, ro = pos[left], pos[right], other[left], other[right]
        apart = (r < lo) & (ro + np.where((kind == 3) & ~is_start[left], 3, 0) < l)
        fine = np.where(kind % 2 == 1, apart & ((kind == 3) | (frame[left] != frame[right])), (kind == 0) | ~is_start[left] | (r - l > 2))
        yield kind[fine], left[fine], right[fine]


def regions_of(codons: np.ndarray, size: int, stops: np.ndarray, min_len: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(frame, start, end) of open regions between stops in each of three frames, the contig's ends included; 0-based."""
    frames, starts, ends = [], [], []
    hit = stops[codons]
    for f in range(3):
        at = np.flatnonzero(hit[f::3]) * 3 + f
        end = np.concatenate([at, [size]])
        start = np.concatenate([[f], at + 3])
        fine = end - start >= min_len
        frames.append(np.full(int(fine.sum()), f))
        starts.append(start[fine])
        ends.append(end[fine])
    return np.concatenate(frames), np.concatenate(starts), np.concatenate(ends)


def reverse_complement(seq: bytes) -> bytes:
    return seq.translate(_REVERSED)[::-1]


def _values(column: pa.Array) -> list:
    """A column's values; lists of numbers as arrays."""
    if not pa.types.is_list(column.type):
        return column.to_pylist()
    cuts = np.concatenate([[0], np.cumsum(np.asarray(column.value_lengths().fill_null(0)))])
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return [flat[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def per_contig(df: DataFrame, kernel: Callable[..., tuple[list, int] | None], outputs: list[tuple[str, str, pa.DataType]], *more: str, keep: tuple[str, ...] = ("contig_id",)) -> DataFrame:
    """Rows that kernel(seq as bytes, *values of the columns `more`) makes of each contig, with the columns `keep`.

    kernel gives a list of columns and their length, or None, or yields several of these. outputs: name, SQL type and Arrow
    type of each column.
    """
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    schema = ", ".join([f"{c} {kinds[c]}" for c in keep] + [f"{n} {t}" for n, t, _ in outputs])
    names = [*keep, *(n for n, _, _ in outputs)]

    def joined(batch: pa.RecordBatch, rows: list[int], sizes: list[int], made: list[list]) -> pa.RecordBatch:
        at = pa.array(np.repeat(np.array(rows, np.int64), sizes))
        columns = [batch[c].take(at) for c in keep]
        for (_, _, kind), parts in zip(outputs, made, strict=True):
            whole = np.concatenate(parts) if isinstance(parts[0], np.ndarray) else list(itertools.chain.from_iterable(parts))
            columns.append(pa.array(whole).cast(kind) if isinstance(whole, np.ndarray) else pa.array(whole, kind))
        return pa.RecordBatch.from_arrays(columns, names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, sizes, made, weight = [], [], [[] for _ in outputs], 0
            extra = [_values(batch[c]) for c in more]
            for i, seq in enumerate(batch["seq"].cast(pa.binary())):
                text = seq.as_py() or b""
                whole = kernel(text, *(e[i] for e in extra))
                for found in whole if isinstance(whole, Iterator) else [whole]:
                    if found is None or not found[1]:
                        continue
                    rows.append(i)
                    sizes.append(found[1])
                    for column, part in zip(made, found[0], strict=True):
                        column.append(part)
                    weight += found[1] + (sum(map(len, found[0][-1])) * ROWS // BYTES if isinstance(found[0][-1], list) else 0)
                    if weight > ROWS:
                        yield joined(batch, rows, sizes, made)
                        rows, sizes, made, weight = [], [], [[] for _ in outputs], 0
            if rows:
                yield joined(batch, rows, sizes, made)

    return df.select(*dict.fromkeys([*keep, "seq", *more])).mapInArrow(run, schema)
