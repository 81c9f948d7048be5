"""Named queries over the test tables: one for each operator, with contigs made from documents by the codec."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import codes
from ..functions import seq as S
from ..operators import contigs as C
from ..operators import calling, detect, graph, orfs, scoring
from ..operators.store import stored
from ..sources import readers, sinks
from . import api

Query = Callable[[SparkSession, str], DataFrame]


def _contigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.contigs_from_documents(spark, sf_dir)


def _over(plan: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: plan(_contigs(spark, sf_dir))


def _found(spark: SparkSession, sf_dir: str, name: str = "orfs", **options) -> tuple[DataFrame, DataFrame]:
    contigs = _contigs(spark, sf_dir)
    return contigs, stored(orfs.orfs(contigs, with_seq=False, **options), name)


def normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.select("doc_id", F.md5(S.normalize_seq(F.col("text"))).alias("seq_md5"))


def _orf_rows(**options) -> Query:
    """ORFs with their stop probability as a logarithm, which never lies halfway between two roundings; null for 0."""
    masked = options.pop("masked", False)

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = orfs.orfs(C.contigs_from_documents(spark, sf_dir, masked), **options)
        return found.select("contig_id", "start", "stop", "frame", "start_codon", "rbs_score", F.round(F.log("pstop"), 7).alias("ln_pstop"), F.md5("seq").alias("seq_md5"))

    return run


def rounded(df: DataFrame, *names: str, digits: int = 9) -> DataFrame:
    return df.withColumns({n: F.round(n, digits) for n in names})


def frame_bias(spark: SparkSession, sf_dir: str) -> DataFrame:
    contigs, found = _found(spark, sf_dir)
    return rounded(scoring.frame_bias(scoring.training_orfs(found), contigs), "pmax", "pmin")


def _scored(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    contigs, found = _found(spark, sf_dir)
    return contigs, stored(scoring.scored_orfs(contigs, found), "scored")


def orf_weight(spark: SparkSession, sf_dir: str) -> DataFrame:
    contigs, scored = _scored(spark, sf_dir)
    return rounded(scored.select("contig_id", "start", "stop", "frame", "weight_rbs", "ln_hold", "ln_weight"), "weight_rbs", "ln_hold", "ln_weight", digits=6)


def _edge_counts(edges: DataFrame) -> DataFrame:
    """Per contig and kind: how many edges, and the sums of the places they lead from and to and of their costs' logarithms."""
    sums = [F.sum("src_pos").alias("src_sum"), F.sum("dst_pos").alias("dst_sum"), F.round(F.sum(F.log("weight")), 4).alias("ln_sum")]
    return edges.groupBy("contig_id", "kind").agg(F.count("*").alias("n"), *sums)


def edges_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _edge_counts(graph.near_edges_of(_contigs(spark, sf_dir)))


def edges_orf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges with the logarithm of the size of their costs (in thousandths, cut), null where that is 0."""
    out = graph.edges_orf(_scored(spark, sf_dir)[1])
    return out.withColumn("ln_cost", F.round(F.when(F.col("weight") != 0, F.log(-F.col("weight"))), 6)).drop("weight")


def edges_desert(spark: SparkSession, sf_dir: str) -> DataFrame:
    contigs, found = _found(spark, sf_dir)
    return _edge_counts(graph.edges_desert(found, contigs))


def edges_terminal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _edge_counts(graph.terminal_edges_of(_contigs(spark, sf_dir)))


def deserts(spark: SparkSession, sf_dir: str) -> DataFrame:
    contigs, found = _found(spark, sf_dir)
    return graph.deserts(found, contigs)


def shortest_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calling.paths_of(_contigs(spark, sf_dir))


def genes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return api.annotate(_contigs(spark, sf_dir)).genes


def gene_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Genes with the logarithm of their scores' size and a digest of their bases."""
    out = genes(spark, sf_dir).withColumns({"ln_score": F.round(F.log(-F.col("score")), 6), "seq_md5": F.md5("seq")})
    return out.drop("score", "seq")


def _written(fmt: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = calling.called(_contigs(spark, sf_dir), with_seq=fmt in ("protein", "nucleotide"))
        return sinks.render_called(fmt, found).select("contig_id", F.md5("text").alias("text_md5"))

    return run


def _made(fmt: str) -> Query:
    """A writer over fixed genes: the whole contig as one reverse gene with score -1234.5."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        contigs = _contigs(spark, sf_dir)
        made = contigs.where("len > 0").select("contig_id", F.lit(0).alias("step"), F.col("len").alias("start"), F.lit(1).alias("stop"), F.lit("-").alias("strand"), F.lit(-1234.5).alias("score"), S.rev_comp(F.col("seq")).alias("seq"))
        out = {"gbk": sinks.genbank, "gff": sinks.gff, "sco": sinks.sco, "protein": sinks.protein_fasta, "nucleotide": sinks.nucleotide_fasta}[fmt](made, contigs)
        return out.select("contig_id", F.md5("text").alias("text_md5"))

    return run


def _parsed(genbank: bool) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        contigs = _contigs(spark, sf_dir)
        name = F.concat(F.lit("c"), F.col("contig_id").cast("string"))
        if genbank:
            value = F.concat(F.lit("LOCUS       "), name, F.lit(" x\nORIGIN\n        1 "), F.regexp_replace("seq", "(.{10})", "$1 "), F.lit("\n//\n"))
        else:
            value = F.concat(F.lit("skipped\n>"), name, F.lit(" note\n"), sinks.wrapped(F.upper("seq"), 70), F.lit("\n"))
        texts = contigs.select(value.alias("value"), F.lit("x.gb" if genbank else "x.fa").alias("name"))
        return readers.parse_text(texts, name="name").select("contig_id", "len", F.md5("seq").alias("seq_md5"))

    return run


def detection(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = detect.table_scores(_contigs(spark, sf_dir))
    return rounded(scores.select("contig_id", "table", "mean_orf_len", "mol_ratio", "reassignment_signal", "composite", "rank"), "mean_orf_len", "mol_ratio", "reassignment_signal", "composite", digits=6)


def _signal(table: int) -> Query:
    return _over(lambda c: rounded(detect.signal_of(c.where("len >= 300"), table).select("contig_id", "signal"), "signal", digits=6))


QUERIES: dict[str, Query] = {
    "genes": gene_rows,
    "normalize_seq": normalize,
    "rev_comp": _over(lambda c: c.select("contig_id", F.md5(S.rev_comp(F.col("seq"))).alias("rc_md5"))),
    "rev_comp_detect": lambda spark, d: C.contigs_from_documents(spark, d, True).select("contig_id", F.md5(S.rev_comp_detect(F.col("seq"))).alias("rc_md5")),
    "genetic_code": lambda spark, d: codes.genetic_code(spark),
    "base_composition": _over(C.composition),
    "genome_pstop": _over(lambda c: rounded(scoring.contig_pstop(c.where("len > 0")), "pstop")),
    "codon_counts": _over(C.codon_counts),
    "n_runs": lambda spark, d: C.n_runs(C.contigs_from_documents(spark, d, True)),
    "score_rbs": _over(lambda c: scoring.score_counts(c).groupBy("score").agg(F.sum("n_ahead").alias("n")).where("n > 0")),
    "rbs_background": _over(lambda c: rounded(scoring.rbs_background(c), "p")),
    "orfs_open": _orf_rows(),
    "orfs_closed": _orf_rows(closed_ends=True),
    "orfs_masked": _orf_rows(mask_n=True, masked=True),
    "orfs_minlen": _orf_rows(min_len=300),
    "rbs_training": lambda spark, d: rounded(scoring.rbs_training(*reversed(_found(spark, d))), "p"),
    "rbs_odds": lambda spark, d: rounded(scoring.rbs_odds(*reversed(_found(spark, d))), "odds", digits=6),
    "gc_frame": _over(lambda c: scoring.gc_frame(c).groupBy("contig_id").agg(F.count("*").alias("n"), *(F.sum(f"gc{i}").alias(f"gc{i}") for i in (1, 2, 3)))),
    "training_orfs": lambda spark, d: scoring.training_orfs(_found(spark, d)[1]),
    "frame_bias": frame_bias,
    "orf_weight": orf_weight,
    "other_end": lambda spark, d: graph.other_end(_found(spark, d)[1]),
    "nodes": lambda spark, d: graph.nodes(_found(spark, d)[1]),
    "deserts": deserts,
    "edges_orf": edges_orf,
    "edges_near": edges_near,
    "edges_desert": edges_desert,
    "edges_terminal": edges_terminal,
    "shortest_path": shortest_paths,
    "mean_max_region": _over(lambda c: rounded(detect.region_stats(c, 11), "mean_len", digits=6)),
    "background_codon_freq": _over(lambda c: detect.background_freq(c, ("tga", "tag"))),
    "hopping_windows": _over(lambda c: detect.hopping_windows(c).select("contig_id", "w", "size", F.md5("piece").alias("piece_md5"))),
    "exclusive_starts": _over(detect.exclusive_starts),
    "table_scores": detection,
    "batch_detect_tsv": _over(lambda c: sinks.batch_tsv(detect.batch_detect(c))),
    "batch_matrix": _over(lambda c: rounded(detect.batch_matrix(c), "t1", "t4", "t6", "t11", "t15", "t25", digits=6)),
    "fasta_parse": _parsed(False),
    "genbank_parse": _parsed(True),
}
QUERIES |= {f"translate_t{t}": _over(lambda c, t=t: c.select("contig_id", F.md5(S.translate_seq(F.col("seq"), t)).alias("aa_md5"))) for t in codes.TABLES}
QUERIES |= {f"orfs_table{t}": _orf_rows(table=t) for t in (4, 6, 15, 25)}
QUERIES |= {f"find_orfs_t{t}": _orf_rows(table=t, starts="table") for t in (1, 11)}
QUERIES |= {f"open_regions_t{t}": _over(lambda c, t=t: orfs.open_regions(c, t)) for t in (4, 11, 15)}
QUERIES |= {f"signal_t{t}": _signal(t) for t in (4, 25, 15, 6)}
QUERIES |= {f"write_{f}": _made(f) for f in ("gbk", "gff", "sco", "protein", "nucleotide")}
QUERIES |= {f"annotate_{f}": _written(f) for f in ("gbk", "gff", "sco", "protein", "nucleotide")}
