"""Sequence sources: FASTA and GenBank text, told apart by content, as contigs (contig_id, ord, seq, len).

A file is one row of text; its records are split inside the row, so files are the unit of work.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.seq import normalize_seq

FORMATS = ("gbk", "gff", "sco")


def fasta_records(text: Column) -> Column:
    """Records (id, raw) of FASTA text: the id keeps its `>`; text before the first header and empty ids are dropped."""
    lines = F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(F.regexp_replace(x, r"[\r\t]", " "))), lambda x: x != "")
    parts = F.split(F.concat(F.lit("\n"), F.array_join(lines, "\n")), "\n>", -1)
    one = lambda p: F.struct(F.concat(F.lit(">"), F.regexp_extract(p, r"^(\S*)", 1)).alias("id"), F.regexp_replace(F.regexp_replace(p, r"^[^\n]*", ""), r"\n", "").alias("raw"))
    return F.transform(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))), one)


def genbank_records(text: Column) -> Column:
    """Records (id, raw) of GenBank text: the second word of LOCUS, and ORIGIN lines less their first word up to //."""
    parts = F.split(F.concat(F.lit("\n"), text), "\nLOCUS", -1)

    def one(p: Column) -> Column:
        origin = F.regexp_extract(p, r"(?s)\nORIGIN[^\n]*\n(.*?)(?:\n//|$)", 1)
        rows = F.transform(F.split(origin, "\n"), lambda x: F.regexp_replace(F.regexp_replace(F.trim(x), r"^\S+", ""), r"\s", ""))
        return F.struct(F.regexp_extract(p, r"^\s*(\S+)", 1).alias("id"), F.array_join(rows, "").alias("raw"))

    return F.transform(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))), one)


def is_genbank(text: Column, name: Column | None = None) -> Column:
    """By the first characters, else by the file's extension."""
    head = F.ltrim(F.regexp_replace(F.substring(text, 1, 200), r"^\s+", ""))
    by_name = F.lit(False) if name is None else name.rlike(r"\.(gb|gbk)$")
    return F.when(head.startswith("LOCUS"), True).when(head.startswith(">"), False).otherwise(by_name)


def parse_text(df: DataFrame, text: str = "value", name: str | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """(keep..., contig_id, ord, seq, len) of each record of each row's text."""
    records = F.when(is_genbank(F.col(text), F.col(name) if name else None), genbank_records(F.col(text))).otherwise(fasta_records(F.col(text)))
    rows = df.select(*keep, F.posexplode(records).alias("ord", "r")).where("r.id not in ('', '>')")
    out = rows.select(*keep, F.col("r.id").alias("contig_id"), "ord", normalize_seq(F.col("r.raw")).alias("seq"))
    return out.withColumn("len", F.length("seq"))


def read_sequences(spark: SparkSession, path: str) -> DataFrame:
    """Contigs of FASTA and GenBank files."""
    files = spark.read.text(path, wholetext=True).select("value", F.col("_metadata.file_name").alias("name"))
    return parse_text(files, name="name")


def contigs_from_stdin(spark: SparkSession, text: str) -> DataFrame:
    """Contigs of all records of a stream: GenBank or FASTA text, told apart by its first characters; other text is an error."""
    if text.strip() and not text.lstrip().startswith((">", "LOCUS")):
        raise ValueError("Cannot tell the format of the input: neither FASTA nor GenBank.")
    return parse_text(spark.createDataFrame([(text.lstrip(),)], "value string"))


def contigs_from_text(spark: SparkSession, text: str, seq_id: str | None = None, only_first: bool = True) -> DataFrame:
    """Contigs of inline text: record 0 of FASTA or GenBank text, or a bare sequence called seq_id or `unnamed`."""
    if not text.strip():
        raise ValueError("Empty DNA sequence.")
    df = spark.createDataFrame([(text,)], "value string")
    if text.lstrip().startswith((">", "LOCUS")):
        out = parse_text(df.select(F.ltrim("value").alias("value")))
        return out.where("ord = 0") if only_first else out
    raw = df.select(F.lit(seq_id or "unnamed").alias("contig_id"), F.lit(0).alias("ord"), normalize_seq(F.regexp_replace("value", r"\s", "")).alias("seq"))
    return raw.withColumn("len", F.length("seq"))
