"""Command line: annotate sequences or rank genetic codes."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..functions.codes import TABLES
from ..sources.readers import contigs_from_stdin, read_sequences
from ..sources.sinks import batch_tsv, nucleotide_fasta, protein_fasta, render, report, sentinel
from .api import annotate, detect_table, detect_tables_batch


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="orfweave", description=__doc__)
    p.add_argument("-i", "--input", default="-")
    p.add_argument("-o", "--output", default="-")
    p.add_argument("-a", "--protein")
    p.add_argument("-d", "--nucleotide")
    p.add_argument("-f", "--format", choices=("gbk", "gff", "sco"), default="gbk")
    p.add_argument("-g", "--table", type=int, default=11, choices=TABLES)
    p.add_argument("-c", "--closed-ends", action="store_true")
    p.add_argument("-m", "--mask-n", action="store_true")
    p.add_argument("-t", "--threads", type=int, default=0)
    p.add_argument("--progress", action="store_true")
    p.add_argument("--detect-table", action="store_true")
    p.add_argument("--detect-table-batch", action="store_true")
    p.add_argument("--yes", action="store_true")
    return p


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    spark = SparkSession.builder.master(f"local[{args.threads or '*'}]").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", str(args.progress).lower()).getOrCreate()
    try:
        contigs = (contigs_from_stdin(spark, sys.stdin.read()) if args.input == "-" else read_sequences(spark, args.input)).cache()
    except ValueError as wrong:
        print(wrong, file=sys.stderr)
        return 1
    if contigs.isEmpty():
        print("No sequences found in input.", file=sys.stderr)
        return 1
    if args.detect_table_batch:
        print("seq_id\tlen\trecommended\tconfidence\ttop_score\trunner_up\trunner_up_score")
        for r in batch_tsv(detect_tables_batch(contigs), strip_id=False).join(contigs.select("contig_id", "ord"), "contig_id").orderBy("ord").collect():
            print(r["line"])
        return 0
    table = args.table
    if args.detect_table:
        first = contigs.orderBy("ord").limit(1)
        ranked = detect_table(first).orderBy("rank").collect()
        shown = first.select("contig_id", "len").collect()[0]
        print(report(ranked, shown["contig_id"], shown["len"]), file=sys.stderr)
        if ranked:
            table = ranked[0]["table"]
            if not args.yes and sys.stdin.isatty():
                said = input(f"Use table {table}? [Y/n/number] ").strip().lower()
                table = args.table if said == "n" else int(said) if said.isdigit() and int(said) in TABLES else table
        else:
            print("Sequence too short for detection.", file=sys.stderr)
    found = annotate(contigs, table, args.closed_ends, args.mask_n)
    order = contigs.select("contig_id", "ord")

    def put(texts, path: str) -> None:
        rows = texts.join(order, "contig_id").orderBy("ord").select("text").toLocalIterator()
        out = sys.stdout if path == "-" else open(path, "w")  # noqa: SIM115
        for r in rows:
            out.write(r["text"])
        if path != "-":
            out.close()

    put(render(args.format, found.genes, contigs, found.orf_counts), args.output)
    if args.protein:
        put(sentinel(protein_fasta(found.genes, contigs, table), found.orf_counts), args.protein)
    if args.nucleotide:
        put(sentinel(nucleotide_fasta(found.genes, contigs), found.orf_counts), args.nucleotide)
    return 0


if __name__ == "__main__":
    sys.exit(main())
