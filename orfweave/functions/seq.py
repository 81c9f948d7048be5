"""Sequence functions as Column expressions. Sequences are lower-case strings over a, c, g, t, n."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .codes import codons

#: Scores of ribosome-binding motifs: (score, motifs, least and greatest offset in the reversed window).
RBS_RULES = (
    (27, ("ggagga",), 5, 10),
    (26, ("ggagga",), 3, 4),
    (25, ("ggagga",), 11, 12),
    (24, ("ggagg",), 5, 10),
    (23, ("ggagg",), 3, 4),
    (22, ("gagga",), 5, 10),
    (21, ("gagga",), 3, 4),
    (20, ("gagga", "ggagg"), 11, 12),
    (19, ("ggaaga", "ggacga", "ggatga", "ggcgga", "ggggga", "ggtgga"), 5, 10),
    (18, ("ggaaga", "ggacga", "ggatga", "ggcgga", "ggggga", "ggtgga"), 3, 4),
    (17, ("ggaaga", "ggacga", "ggatga", "ggcgga", "ggggga", "ggtgga"), 11, 12),
    (16, ("gagg", "ggag"), 5, 10),
    (15, ("agga",), 5, 10),
    (14, ("ggcgg", "ggggg", "ggtgg"), 5, 10),
    (13, ("agg", "gag", "gga"), 5, 10),
    (12, ("agga", "gagg", "ggag"), 11, 12),
    (11, ("agga", "gagg", "ggag"), 3, 4),
    (10, ("gagga", "ggagg", "ggagga"), 13, 15),
    (9, ("gaaga", "gacga", "gatga"), 5, 10),
    (8, ("ggcgg", "ggggg", "ggtgg"), 3, 4),
    (7, ("ggcgg", "ggggg", "ggtgg"), 11, 12),
    (6, ("agg", "gag", "gga"), 11, 12),
    (5, ("gaaga", "gacga", "gatga"), 3, 4),
    (4, ("gaaga", "gacga", "gatga"), 11, 12),
    (3, ("agga", "gagg", "ggag"), 13, 15),
    (2, ("agg", "gag", "gga", "ggaaga", "ggacga", "ggatga", "ggcgg", "ggggg", "ggtgg"), 13, 15),
    (1, ("agg", "gag", "gga"), 3, 4),
)


def normalize_seq(raw: Column) -> Column:
    """acgt and n in lower case; u is t; s, b, v are g; anything else is a, byte by byte."""
    text = F.decode(F.encode(raw, "UTF-8"), "ISO-8859-1")
    return F.regexp_replace(F.translate(text, "ACGTNUuSsBbVv", "acgtnttgggggg"), "[^acgtn]", "a")


def rev_comp(seq: Column) -> Column:
    """Reverse complement of gene calling: n becomes a."""
    return F.translate(F.reverse(seq), "acgtn", "tgcaa")


def rev_comp_detect(seq: Column) -> Column:
    """Reverse complement of code detection: n stays n."""
    return F.translate(F.reverse(seq), "acgtn", "tgcan")


def translate_seq(seq: Column, table: int = 11) -> Column:
    """Amino acids by threes; unknown codons and a partial tail are X. The literal map is built once per plan."""
    lookup = F.create_map(*(F.lit(x) for pair in sorted(codons(table).items()) for x in pair))
    # Blocks of 300 bases keep substr near the start of a short string.
    blocks = F.when(F.length(seq) > 0, F.transform(F.sequence(F.lit(0), ((F.length(seq) - 1) / 300).cast("int")), lambda b: F.substring(seq, b * 300 + 1, F.lit(300)))).otherwise(F.array().cast("array<string>"))
    one = lambda piece: F.array_join(F.transform(F.sequence(F.lit(0), ((F.length(piece) - 1) / 3).cast("int")), lambda i: F.coalesce(lookup[F.substring(piece, i * 3 + 1, F.lit(3))], F.lit("X"))), "")
    return F.array_join(F.transform(blocks, one), "")


def score_rbs(window: Column) -> Column:
    """Score 0 to 27 of a window upstream of a start, read backwards; the first matching rule wins.

    A motif that starts within a range of offsets is contained in a short piece, which is cheaper than a pattern. Rules
    are in descending order, so the best score over the four ranges is the first match.
    """
    back = F.reverse(window)
    best = []
    for low, high in sorted({(a, b) for _, _, a, b in RBS_RULES}):
        out = F.when(F.lit(False), 0)
        for score, motifs, a, b in RBS_RULES:
            if (a, b) == (low, high):
                found = F.lit(False)
                for m in motifs:
                    found = found | F.substring(back, low + 1, high - low + len(m)).contains(m)
                out = out.when(found, score)
        best.append(out.otherwise(0))
    return F.when(window.rlike("gg|ga|ag"), F.greatest(*best)).otherwise(0)


def count_base(seq: Column, base: str) -> Column:
    return F.length(seq) - F.length(F.replace(seq, F.lit(base), F.lit("")))


def stop_probability(pa: Column, pt: Column, pg: Column) -> Column:
    return pt * pa * pa + pt * pg * pa + pt * pa * pg


def pstop(seq: Column) -> Column:
    """Probability of a stop codon by the composition of seq; null if it is empty."""
    n = F.nullif(F.length(seq), F.lit(0)).cast("double")
    return stop_probability(count_base(seq, "a") / n, count_base(seq, "t") / n, count_base(seq, "g") / n)


def genome_pstop(seq: Column) -> Column:
    """The same over both strands pooled; n counts in the length alone."""
    n = F.nullif(F.length(seq), F.lit(0)).cast("double")
    a, t, c, g = (count_base(seq, b) for b in "atcg")
    return stop_probability((a + t) / (2 * n), (a + t) / (2 * n), (c + g) / (2 * n))


def max_idx(a: Column, b: Column, c: Column) -> Column:
    return F.when((a > b) & (a > c), 1).when(b > c, 2).otherwise(3)


def min_idx(a: Column, b: Column, c: Column) -> Column:
    return F.when((a > b) & (b > c), 3).when(a > b, 2).when(a > c, 3).otherwise(1)


def score_gap(length: Column, diff: bool, pgap: Column) -> Column:
    """Cost of a gap; a long one costs its length and no strand switch."""
    g = 1 - pgap
    near = F.pow(g, -length / 3.0) + (20.0 if diff else 0.0)
    return F.when(length > 300, F.pow(g, F.lit(100.0)) + length).otherwise(near)


def score_overlap(length: Column, diff: bool, p: Column) -> Column:
    return F.pow(1 - p, -length.cast("double")) + (20.0 if diff else 0.0)


def quantised(weight: Column) -> Column:
    """Thousandths, cut towards zero; what is not finite becomes 0."""
    w = weight * 1000.0
    whole = F.when(w < 0, F.ceil(w)).otherwise(F.floor(w))
    exact = F.when(F.abs(w) < 1e15, whole.cast("double")).otherwise(w)
    return F.when(F.isnan(w) | (F.abs(w) == float("inf")), F.lit(0.0)).otherwise(exact)


def scientific(x: Column) -> Column:
    """Two decimals and a bare exponent, like -4.83E2; inf or -inf for what is infinite."""
    return F.regexp_replace(F.regexp_replace(F.replace(F.format_string("%.2E", x), F.lit("INFINITY"), F.lit("inf")), r"E\+0*(\d)", "E$1"), r"E-0*(\d)", "E-$1")
