"""The public API: annotation, ORFs, detection and metadata over DataFrames or single sequences."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.codes import check_table
from ..operators.calling import Calling, genes_of, scored_of
from ..operators.detect import batch_detect, table_scores
from ..operators.orfs import orfs
from ..sources.readers import contigs_from_text
from ..sources.sinks import nucleotide_fasta, protein_fasta, render, sentinel
from .records import Gene, Orf, TableScore


@dataclass
class Annotation:
    genes: DataFrame
    scored: DataFrame
    contigs: DataFrame

    @property
    def orf_counts(self) -> DataFrame:
        return self.scored.groupBy("contig_id").agg(F.count("*").alias("n_orfs"))


def annotate(contigs: DataFrame, table: int = 11, closed_ends: bool = False, mask_n: bool = False, min_orf_len: int = 90) -> Annotation:
    """Genes (contig_id, step, start, stop, strand, score, start_codon, seq) of every contig, and its scored ORFs, each
    found contig by contig where it is read."""
    how = Calling(check_table(table), closed_ends, mask_n, min_orf_len)
    return Annotation(genes_of(contigs, how), scored_of(contigs, how), contigs)


def find_orfs(contigs: DataFrame, table: int = 11, closed_ends: bool = False, mask_n: bool = False, min_orf_len: int = 90, starts: str = "table") -> DataFrame:
    """ORFs with the table's own start set (or, starts="caller", that of gene calling)."""
    check_table(table)
    out = orfs(contigs, table, closed_ends, mask_n, min_orf_len, starts)
    return out.withColumns({"weight_rbs": F.lit(1.0), "hold": F.lit(1.0), "weight": F.lit(1.0)})


def detect_table(contigs: DataFrame, min_orf_len: int = 90) -> DataFrame:
    return table_scores(contigs, min_orf_len)


def detect_tables_batch(contigs: DataFrame, min_orf_len: int = 90) -> DataFrame:
    return batch_detect(contigs, min_orf_len)


def orfs_of_sequence(spark: SparkSession, sequence: str, table: int = 11, closed_ends: bool = False, mask_n: bool = False, min_orf_len: int = 90) -> list[Orf]:
    """ORFs of one sequence with the table's own starts, in their order of emission."""
    check_table(table)
    found = find_orfs(contigs_from_text(spark, sequence), table, closed_ends, mask_n, min_orf_len)
    return Orf.all_of(found.orderBy("emit_ord").withColumnRenamed("seq", "sequence"))


def scores_of_sequence(spark: SparkSession, sequence: str, min_orf_len: int = 90) -> list[TableScore]:
    """Scores of the candidate tables for one sequence, the best first; none for a short sequence."""
    return TableScore.all_of(detect_table(contigs_from_text(spark, sequence), min_orf_len).orderBy("rank"))


def annotate_sequence(spark: SparkSession, sequence: str, seq_id: str | None = None, format: str = "gbk", table: int = 11, closed_ends: bool = False, mask_n: bool = False, detect: bool = False, min_orf_len: int = 90) -> dict:
    """One sequence: texts, genes and the table used."""
    if format not in ("gbk", "gff", "sco"):
        raise ValueError(f"Unknown format {format}")
    check_table(table)
    contigs = contigs_from_text(spark, sequence, seq_id)
    if detect:
        best = detect_table(contigs, min_orf_len).where("rank = 1").collect()
        table = best[0]["table"] if best else table
    found = annotate(contigs, table, closed_ends, mask_n, min_orf_len)
    found.genes = found.genes.cache()
    text = lambda df: "".join(r["text"] for r in df.collect())
    return {
        "primary": text(render(format, found.genes, contigs, found.orf_counts)), "protein": text(sentinel(protein_fasta(found.genes, contigs, table), found.orf_counts)),
        "nucleotide": text(sentinel(nucleotide_fasta(found.genes, contigs), found.orf_counts)), "genes": Gene.all_of(found.genes.orderBy("step")), "table_used": table,
    }
