"""Sinks: annotation and detection results as text. Each is one string per contig; `write_text` puts them in order."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.codes import table_name
from ..functions.seq import scientific, translate_seq

NO_ORFS = "#id:\t{} NO ORFS FOUND\n"


def bare(contig_id: Column) -> Column:
    return F.regexp_replace(contig_id.cast("string"), "^>+", "")


def wrapped(text: Column, width: int = 60) -> Column:
    """Lines of `width` characters, without an empty one at the end."""
    return F.regexp_replace(text, f"(.{{{width}}})(?=.)", "$1\n")


#: What a gene's line and a contig's text are made of: a gene's columns by name, and the lines of its genes as `body`.
Get = Callable[[str], Column]


def _sco_line(g: Get) -> Column:
    return F.concat(F.concat_ws("\t", g("start").cast("string"), g("stop").cast("string"), g("strand"), scientific(g("score"))), F.lit("\n"))


def _gff_line(g: Get, source: str = "orfweave") -> Column:
    score = scientific(g("score"))
    a, b = g("start").cast("string"), g("stop").cast("string")
    return F.concat(F.concat_ws("\t", bare(F.col("contig_id")), F.lit(source), F.lit("CDS"), a, b, score, g("strand"), F.lit("0"), F.concat(F.lit("ID=CDS_"), a, F.lit("_"), b, F.lit(";score="), score)), F.lit("\n"))


def _genbank_line(g: Get) -> Column:
    place = F.concat(g("start").cast("string"), F.lit(".."), g("stop").cast("string"))
    place = F.when(g("strand") == "-", F.concat(F.lit("complement("), place, F.lit(")"))).otherwise(place)
    return F.concat(F.lit("     CDS             "), place, F.lit('\n                     /note="score='), scientific(g("score")), F.lit('"\n'))


def _fasta_line(g: Get, seq: Column) -> Column:
    return F.concat(F.lit(">"), bare(F.col("contig_id")), F.lit("_"), g("start").cast("string"), F.lit("_"), g("stop").cast("string"), F.lit(" "), g("strand"), F.lit("\n"), wrapped(seq), F.lit("\n"))


def _gff_text() -> Column:
    return F.concat(F.lit("##gff-version 3\n"), F.col("body"))


def _genbank_text() -> Column:
    # Cut in one pass: substring scans a string from its start, which grows with the square of a contig's length.
    line = lambda part, i: F.concat(F.lpad((i * 60 + 1).cast("string"), 9, " "), F.lit(" "), F.regexp_replace(part, "(.{10})(?=.)", "$1 "))
    rows = F.when(F.col("len") > 0, F.transform(F.split(wrapped(F.col("seq")), "\n"), line)).otherwise(F.array().cast("array<string>"))
    name = bare(F.col("contig_id"))
    head = F.concat(F.lit("LOCUS       "), name, F.lit(" "), F.lpad(F.col("len").cast("string"), 10, " "), F.lit(" bp    DNA             PHG\nDEFINITION  "), name, F.lit("\nFEATURES             Location/Qualifiers\n     source          1.."), F.col("len").cast("string"), F.lit("\n"))
    return F.concat(head, F.col("body"), F.lit("ORIGIN\n\n"), F.array_join(rows, "\n"), F.lit("\n//\n"))


def _text(genes: DataFrame, contigs: DataFrame, line: Column, text: Column) -> DataFrame:
    """Texts of genes and contigs that meet by id."""
    rows = genes.groupBy("contig_id").agg(F.sort_array(F.collect_list(F.struct("step", line.alias("line")))).alias("rows"))
    body = rows.select("contig_id", F.array_join(F.transform("rows", lambda r: r["line"]), "").alias("body"))
    return contigs.join(body, "contig_id", "left").withColumn("body", F.coalesce("body", F.lit(""))).select("contig_id", text.alias("text"))


def sco(genes: DataFrame, contigs: DataFrame) -> DataFrame:
    return _text(genes, contigs, _sco_line(F.col), F.col("body"))


def gff(genes: DataFrame, contigs: DataFrame, source: str = "orfweave") -> DataFrame:
    return _text(genes, contigs, _gff_line(F.col, source), _gff_text())


def genbank(genes: DataFrame, contigs: DataFrame) -> DataFrame:
    return _text(genes, contigs, _genbank_line(F.col), _genbank_text())


def protein_fasta(genes: DataFrame, contigs: DataFrame, table: int = 11) -> DataFrame:
    return _text(genes, contigs, _fasta_line(F.col, translate_seq(F.col("seq"), table)), F.col("body"))


def nucleotide_fasta(genes: DataFrame, contigs: DataFrame) -> DataFrame:
    return _text(genes, contigs, _fasta_line(F.col, F.col("seq")), F.col("body"))


def render_called(fmt: str, called: DataFrame, table: int = 11) -> DataFrame:
    """Texts of contigs that hold their genes (`calling.called`), nothing being joined; fmt: one of WRITERS, protein or
    nucleotide. Contigs without any ORF get the sentinel line; rows without an id have no text."""
    lines = {
        "gbk": _genbank_line, "gff": _gff_line, "sco": _sco_line, "protein": lambda g: _fasta_line(g, translate_seq(g("seq"), table)),
        "nucleotide": lambda g: _fasta_line(g, g("seq")),
    }
    text = {"gbk": _genbank_text, "gff": _gff_text}.get(fmt, lambda: F.col("body"))()
    body = F.array_join(F.transform("genes", lambda gene: lines[fmt](lambda name: gene[name])), "")
    out = called.withColumn("body", body).select("contig_id", "n_orfs", text.alias("text"))
    return out.select("contig_id", F.when((F.col("n_orfs") == 0) | F.col("contig_id").isNull(), _missing(F.col("contig_id").cast("string"))).otherwise(F.col("text")).alias("text"))


def _missing(name: Column) -> Column:
    return F.concat(F.lit("#id:\t"), name, F.lit(" NO ORFS FOUND\n"))


WRITERS = {"gbk": genbank, "gff": gff, "sco": sco}


def render(fmt: str, genes: DataFrame, contigs: DataFrame, orf_counts: DataFrame | None = None) -> DataFrame:
    """Text in a format; with orf_counts (contig_id, n_orfs), contigs without any ORF get the sentinel line."""
    if fmt not in WRITERS:
        raise ValueError(f"Unknown format {fmt}; one of {sorted(WRITERS)}")
    out = WRITERS[fmt](genes, contigs)
    return out if orf_counts is None else sentinel(out, orf_counts)


def sentinel(out: DataFrame, orf_counts: DataFrame, strip_id: bool = False) -> DataFrame:
    name = bare(F.col("contig_id")) if strip_id else F.col("contig_id").cast("string")
    return out.join(orf_counts, "contig_id", "left").select("contig_id", F.when(F.coalesce("n_orfs", F.lit(0)) == 0, _missing(name)).otherwise(F.col("text")).alias("text"))


def write_text(texts: DataFrame, order: DataFrame, path: str) -> None:
    """Texts in the order of (contig_id, ord), as one text sink."""
    texts.join(order.select("contig_id", "ord"), "contig_id").orderBy("ord").select(F.regexp_replace("text", r"\n$", "").alias("value")).coalesce(1).write.text(path)


def batch_tsv(batch: DataFrame, strip_id: bool = True) -> DataFrame:
    """(contig_id, line) of batch detection."""
    name = bare(F.col("contig_id")) if strip_id else F.col("contig_id").cast("string")
    score = lambda c: F.format_string("%.4f", F.col(c))
    return batch.select("contig_id", F.concat_ws("\t", name, F.col("len").cast("string"), F.col("recommended").cast("string"), "confidence", score("top_score"), F.col("runner_up").cast("string"), score("runner_up_score")).alias("line"))


def report(scores: list, name: str, length: int) -> str:
    """A ranked table of one contig's scores for people; scores: rows of table_scores in order of rank."""
    # Fixed texts and widths: the report's layout.
    rule = "─" * 78
    columns = "{:>4}  {:>5}  {:<40}  {:>10}  {:>15}  {:>9}"
    lines = [rule, f"Codon table detection: seq={name} len={length} nt (first record)", rule]
    lines.append(columns.format("Rank", "Table", "Name", "ORF ratio", "Reass. signal", "Composite"))
    for place, r in enumerate(scores, 1):
        numbers = f"{r['mol_ratio']:.2f}", f"{r['reassignment_signal']:.3f}", f"{r['composite']:.2f}"
        lines.append(columns.format(place, r["table"], shortened(table_name(r["table"])), *numbers))
        for d in r["codon_details"] or ():
            lines.append(f"{'':14}└─ {d['codon']}: bg={100 * d['background_freq']:.1f}%  orf={100 * d['orf_freq']:.1f}%  ratio={d['ratio']:.2f}")
    best = scores[0]["table"] if scores else 11
    lines.append(f"\nRecommended table: {best}  ({table_name(best)})  [confidence: {confidence([r['composite'] for r in scores])}]")
    return "\n".join([*lines, rule])


def shortened(name: str, most: int = 38) -> str:
    """A name of at most `most` characters."""
    return name if len(name) <= most else name[: most - 2] + ".."


def confidence(composites: list[float]) -> str:
    """How far the best score is from the next."""
    if len(composites) < 2:
        return "low"
    top, second = composites[:2]
    if second <= 0:
        return "high" if top > 0 else "low"
    return "high" if top / second > 2 else "medium" if top / second > 1.2 else "low"
