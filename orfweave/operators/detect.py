"""Genetic-code detection: which table's stops leave the longest open regions, as one declarative plan."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.codes import CANDIDATES, stop_codons
from . import kernels as K
from .contigs import windows_at
from .orfs import open_regions

MIN_LEN, TOP, WINDOW_TOP, WINDOW_CODONS = 300, 20, 10, 300
TARGETS = {4: ("tga",), 25: ("tga",), 15: ("tag",), 6: ("taa", "tag")}
SIBLINGS = {4: ("tgg",), 25: ("gga", "ggc", "ggg", "ggt")}
EXCLUSIVE = ("att", "atc", "ata", "gtg")


def region_stats(contigs: DataFrame, table: int, min_len: int = 90) -> DataFrame:
    """(contig_id, mean_len, max_len) of open regions of both strands; 0 without any."""
    return region_stats_by_table(contigs, (table,), min_len).drop("table")


def region_stats_by_table(contigs: DataFrame, tables: tuple[int, ...], min_len: int = 90) -> DataFrame:
    """(contig_id, table, mean_len, max_len) for all tables from one pass over the contigs: a contig's regions are summed
    where it is read."""
    ends = {t: tuple(stop_codons(t)) for t in tables}

    def found(seq: bytes):
        x = K.codes_of(seq)
        sizes: dict[int, list] = {t: [] for t in tables}
        for y in (x, np.where(x < 4, 3 - x, 4).astype(np.uint8)[::-1]):
            codons = K.codons_of(y) if len(y) >= 3 else y[:0]
            for t in tables:
                _, start, end = K.regions_of(codons, len(x), K.flags(ends[t]), min_len)
                sizes[t].append(end - start)
        every = [np.concatenate(sizes[t]) for t in tables]
        return [np.array(tables), np.array([e.mean() if len(e) else 0.0 for e in every]), np.array([e.max() if len(e) else 0 for e in every])], len(tables)

    return K.per_contig(contigs, found, [("table", "int", pa.int32()), ("mean_len", "double", pa.float64()), ("max_len", "int", pa.int32())])


def background_freq(contigs: DataFrame, codons: tuple[str, ...]) -> DataFrame:
    """(contig_id, total, bg_<codon>): counts over the codons of frame 0."""
    frame = windows_at(contigs, 3).where("pos % 3 = 1")
    return frame.groupBy("contig_id").agg(F.count("*").alias("total"), *(F.count_if(F.col("piece") == c).alias(f"bg_{c}") for c in codons))


def top_regions(contigs: DataFrame, table: int, top: int = TOP) -> DataFrame:
    """The longest forward regions of at least 90 bases, ties by start."""
    order = Window.partitionBy("contig_id").orderBy(F.desc(F.col("region_end") - F.col("region_start")), "region_start")
    return open_regions(contigs, table, 90, both_strands=False).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def codons_inside(regions: DataFrame, contigs: DataFrame, codons: tuple[str, ...]) -> DataFrame:
    """regions joined with counts of codons inside them, the last whole codon left out; a region's own string is cut up."""
    piece = F.substring("seq", F.col("region_start") + 1, F.col("region_end") - F.col("region_start"))
    n = F.greatest(F.floor((F.col("region_end") - F.col("region_start") - 6) / 3) + 1, F.lit(0)).cast("int")
    cut = regions.join(contigs.select("contig_id", "seq"), "contig_id").withColumns({"piece": piece, "n": n})
    threes = F.regexp_extract_all(F.substring("piece", F.lit(1), F.col("n") * 3), F.lit("([a-z]{3})"), F.lit(1))
    times = lambda c: F.size(F.filter("threes", lambda x: x == c)).cast("long").alias(f"in_{c}")
    return cut.withColumn("threes", threes).select(*regions.columns, F.col("n").cast("long").alias("n"), *(times(c) for c in codons))


def plain_signal(contigs: DataFrame, table: int) -> DataFrame:
    """(contig_id, signal, details) for tables 4 and 25: reassigned over sibling codons in the longest regions."""
    target, siblings = TARGETS[table][0], SIBLINGS[table]
    inside = codons_inside(top_regions(contigs, table), contigs, (target, *siblings)).groupBy("contig_id").agg(F.sum("n").alias("n"), *(F.sum(f"in_{c}").alias(f"in_{c}") for c in (target, *siblings)))
    both = contigs.select("contig_id").join(background_freq(contigs, (target,)), "contig_id", "left").join(inside, "contig_id", "left").na.fill(0)
    bg = F.when(F.col("total") > 0, F.col(f"bg_{target}") / F.col("total")).otherwise(0.0)
    freq = F.when(F.col("n") > 0, F.col(f"in_{target}") / F.col("n")).otherwise(0.0)
    ratio = F.when(bg > 0, freq / bg).otherwise(0.0)
    others = sum((F.col(f"in_{c}") for c in siblings[1:]), F.col(f"in_{siblings[0]}"))
    signal = F.least(F.when(others > 0, F.col(f"in_{target}") / others).otherwise(ratio), F.lit(3.0))
    return both.select("contig_id", signal.alias("signal"), F.array(F.struct(F.lit(target).alias("codon"), bg.alias("background_freq"), freq.alias("orf_freq"), ratio.alias("ratio"))).alias("details"))


def hopping_windows(contigs: DataFrame) -> DataFrame:
    """(contig_id, w, size, piece): windows of 3000 to 9000 bases that hop by a fifth; contigs under 3000 have none."""
    size = F.least(F.greatest("len", F.lit(3000)), F.lit(9000))
    sized = contigs.where("len >= 3000").withColumn("size", size)
    hops = sized.select("contig_id", "seq", "size", F.explode(F.sequence(F.lit(0), F.col("len") - F.col("size"), F.floor(F.col("size") / 5).cast("int"))).alias("w"))
    return hops.select("contig_id", "w", "size", F.substring("seq", F.col("w") + 1, F.col("size")).alias("piece"))


def window_signals(contigs: DataFrame, table: int) -> DataFrame:
    """(contig_id, w, signal, details): a window's smallest ratio of codon frequencies inside and outside its ten longest regions."""
    targets = TARGETS[table]
    hops = hopping_windows(contigs).select(F.struct("contig_id", "w").alias("contig_id"), F.col("piece").alias("seq"), F.col("size").alias("len"))
    inside = codons_inside(top_regions(hops, table, WINDOW_TOP), hops, targets).groupBy("contig_id").agg(F.sum("n").alias("n"), *(F.sum(f"in_{c}").alias(f"in_{c}") for c in targets)).where(F.col("n") >= WINDOW_CODONS)
    both = inside.join(background_freq(hops, targets), "contig_id")
    bg, freq = {c: F.col(f"bg_{c}") / F.col("total") for c in targets}, {c: F.col(f"in_{c}") / F.col("n") for c in targets}
    ratio = {c: F.when(bg[c] > 0, freq[c] / bg[c]).otherwise(0.0) for c in targets}
    details = F.array(*(F.struct(F.lit(c).alias("codon"), bg[c].alias("background_freq"), freq[c].alias("orf_freq"), ratio[c].alias("ratio")) for c in targets))
    return both.select("contig_id.contig_id", "contig_id.w", F.least(F.lit(3.0), *(ratio[c] for c in targets), *([F.lit(3.0)] if len(targets) == 1 else [])).alias("signal"), details.alias("details"))


def sliding_signal(contigs: DataFrame, table: int) -> DataFrame:
    """(contig_id, signal, details): mean of the best quarter of windows less a half, within 0 and 3; 0 without windows."""
    by = Window.partitionBy("contig_id")
    ranked = window_signals(contigs, table).withColumns({"rank": F.row_number().over(by.orderBy(F.desc("signal"), "w")), "n": F.count("*").over(by)})
    best = ranked.where(F.col("rank") <= F.greatest(F.floor(F.col("n") / 4), F.lit(1))).groupBy("contig_id").agg(F.avg("signal").alias("mean"), F.min_by("details", "rank").alias("details"))
    signal = F.coalesce(F.least(F.greatest(F.col("mean") - 0.5, F.lit(0.0)), F.lit(3.0)), F.lit(0.0))
    return contigs.select("contig_id").join(best, "contig_id", "left").select("contig_id", signal.alias("signal"), "details")


def exclusive_starts(contigs: DataFrame) -> DataFrame:
    """(contig_id, n): forward regions of table 11 that begin with a start only it has."""
    first = open_regions(contigs, 11, 90, both_strands=False).join(contigs.select("contig_id", "seq"), "contig_id").where(F.substring("seq", F.col("region_start") + 1, F.lit(3)).isin(*EXCLUSIVE))
    counts = first.groupBy("contig_id").agg(F.count("*").alias("n"))
    return contigs.select("contig_id").join(counts, "contig_id", "left").select("contig_id", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def signal_of(contigs: DataFrame, table: int) -> DataFrame:
    if table in SIBLINGS:
        return plain_signal(contigs, table)
    return sliding_signal(contigs, table) if table in TARGETS else contigs.select("contig_id", F.lit(1.0).alias("signal"))


def table_scores(contigs: DataFrame, min_len: int = 90) -> DataFrame:
    """(contig_id, table, mean_orf_len, mol_ratio, reassignment_signal, composite, codon_details, rank); short contigs have none."""
    some = contigs.where(F.col("len") >= MIN_LEN)
    stats = region_stats_by_table(some, CANDIDATES, min_len)
    base = stats.where(F.col("table") == 11).select("contig_id", F.greatest("mean_len", F.lit(1.0)).alias("base_mean"), F.greatest("max_len", F.lit(1)).alias("base_max"))
    none = F.lit(None).cast("array<struct<codon:string,background_freq:double,orf_freq:double,ratio:double>>")
    parts = []
    for t in CANDIDATES:
        signals = signal_of(some, t)
        signals = signals if "details" in signals.columns else signals.withColumn("details", none)
        parts.append(signals.withColumn("table", F.lit(t)))
    every = reduce(DataFrame.unionByName, parts).join(stats, ["contig_id", "table"]).join(base, "contig_id").join(exclusive_starts(some), "contig_id")
    mol, far = F.col("mean_len") / F.col("base_mean"), F.col("max_len") / F.col("base_max")
    boost = F.when(F.col("table").isin(1, 11), 1.0).when(F.col("signal") > 0.6, 1.0).when(F.col("signal") > 0.3, F.when(far > 2.0, 1.0).otherwise(0.7)).otherwise(F.when(far > 2.5, 0.7).otherwise(0.4))
    scored = every.select("contig_id", "table", F.col("mean_len").alias("mean_orf_len"), mol.alias("mol_ratio"), F.col("signal").alias("reassignment_signal"), (mol * F.col("signal") * boost).alias("composite"), F.col("details").alias("codon_details"), "n")
    # Tables 1 and 11 tie often: 11 goes first if it has starts of its own.
    tie = F.when((F.col("table") == 11) & (F.col("n") > 0), 0).otherwise(F.col("table"))
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy("contig_id").orderBy(F.desc("composite"), tie))).drop("n")


def batch_detect(contigs: DataFrame, min_len: int = 90) -> DataFrame:
    """(contig_id, len, recommended, confidence, top_score, runner_up, runner_up_score)."""
    top = table_scores(contigs, min_len).where("rank <= 2").groupBy("contig_id").pivot("rank", [1, 2]).agg(F.first("table").alias("t"), F.first("composite").alias("c"))
    ratio = F.col("1_c") / F.col("2_c")
    level = F.when(F.col("1_t").isNull(), "too_short").when(F.col("2_c") <= 0, F.when(F.col("1_c") > 0, "high").otherwise("low")).when(ratio > 2, "high").when(ratio > 1.2, "medium").otherwise("low")
    both = contigs.select("contig_id", "len").join(top, "contig_id", "left")
    return both.select("contig_id", "len", F.coalesce("1_t", F.lit(11)).alias("recommended"), level.alias("confidence"), F.coalesce("1_c", F.lit(0.0)).alias("top_score"), F.coalesce("2_t", F.lit(11)).alias("runner_up"), F.coalesce("2_c", F.lit(0.0)).alias("runner_up_score"))


def batch_matrix(contigs: DataFrame, min_len: int = 90) -> DataFrame:
    wide = table_scores(contigs, min_len).groupBy("contig_id").pivot("table", [1, 4, 6, 11, 15, 25]).agg(F.first("composite"))
    tables = [F.coalesce(F.col(f"`{t}`"), F.lit(0.0)).alias(f"t{t}") for t in (1, 4, 6, 11, 15, 25)]
    return batch_detect(contigs, min_len).select("contig_id", "len", "recommended", "confidence").join(wide, "contig_id", "left").select("contig_id", "len", "recommended", "confidence", *tables)
