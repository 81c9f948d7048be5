"""The corpus pipeline: quality rules, line dedup, near duplicates, secrets, packing.

Each stage takes what its predecessor kept, as written and read again, and its decisions take effect: rejected documents
go, failed and repeated lines are cut from texts, one document of each near-duplicate group stays, secrets are masked,
and what is left is packed. All stages but the last return the columns of documents, n_chars brought up to date.

Defined results: null and empty texts have no words, so the first stage rejects them; a stage that is given them all the same
keeps them as they are (line dedup, near duplicates), masks nothing, or packs the end token alone. Long texts are worked
through whole. Of documents with equal texts the one with the smallest id stays; rows that repeat an id are one document to
stages that compare documents and stay or go together. Columns other than those of documents are dropped; null values in lang
or source are kept. Empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orfweave.llm import jaccard, line_dedup, packing, quality, secrets
from orfweave.llm.common import shared_folder, table, words

#: A document of whose words less than LEAST_LEFT per cent are left by line dedup, or fewer than quality rules ask for, was a
#: copy of earlier ones; the shreds that remain are no document.
LEAST_LEFT = 50
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _documents(df: DataFrame) -> DataFrame:
    return df.withColumn("n_chars", F.length(F.coalesce("text", F.lit(""))).cast("long")).select(*COLUMNS)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep, without their failed lines."""
    judged = quality.quality(docs.select(*COLUMNS)).where("kept")
    return _documents(judged.select("doc_id", F.col("clean_text").alias("text"), "row.lang", "row.source"))


def repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines of runs that an earlier place holds; those that were mostly such lines go."""
    n = F.size(words(F.col("text")))
    cut = line_dedup.deduplicated(docs.select(*COLUMNS).withColumn("__words", n)).withColumn("__left", n)
    enough = (F.col("__left") >= quality.MIN_WORDS) & (100 * F.col("__left") >= LEAST_LEFT * F.col("__words"))
    return _documents(cut.where((F.col("__left") == F.col("__words")) | enough))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of linked documents."""
    gone = jaccard.link(docs).where("doc_id <> component_id").select("doc_id")
    return _documents(docs.join(gone, "doc_id", "left_anti"))


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets masked; a null text is then empty."""
    found = secrets.scan(docs.select(*COLUMNS), secrets.train(docs))
    return _documents(found.select("row.doc_id", secrets.masked(F.col("text"), F.col("spans")).alias("text"), "row.lang", "row.source"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 2048 tokens."""
    return packing.pack(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", repeated_lines),
    ("ngram_jaccard", near_duplicates),
    ("secret_scans", secret_scans),
    ("packing", packed),
]
#: Tokens can't be stated in SQL; tests/llm/test_pipeline.py holds each stage and the whole against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each but the last is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = shared_folder(spark, f"stage_{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
