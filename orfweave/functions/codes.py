"""Genetic codes: the supported NCBI tables as Python metadata, literal maps and a dimension table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Amino acids of the 64 codons in NCBI's order (bases t, c, a, g; the third base runs fastest).
BASES = "tcag"
STANDARD = "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"
#: How the other tables read stop codons of the standard table.
REASSIGNED = {1: {}, 4: {"tga": "W"}, 6: {"taa": "Q", "tag": "Q"}, 11: {}, 15: {"tag": "Q"}, 25: {"tga": "G"}}
NAMES = {1: "Standard", 4: "Mold/Protozoan/Coelenterate Mitochondrial + Mycoplasma/Spiroplasma", 6: "Ciliate, Dasycladacean and Hexamita Nuclear", 11: "Bacterial, Archaeal and Plant Plastid", 15: "Blepharisma Nuclear", 25: "Candidate Division SR1 and Gracilibacteria"}
STARTS = {1: ("atg", "ttg", "ctg"), 4: ("tta", "ttg", "ctg", "att", "atc", "ata", "atg", "gtg"), 6: ("atg",), 11: ("ttg", "ctg", "att", "atc", "ata", "atg", "gtg"), 15: ("atg",), 25: ("ttg", "atg", "gtg")}
CALLER_STARTS = ("atg", "gtg", "ttg")
START_WEIGHTS = {"atg": 0.85, "gtg": 0.10, "ttg": 0.05}
TABLES = (1, 4, 6, 11, 15, 25)
#: Tables that detection ranks.
CANDIDATES = (1, 4, 11, 15, 25)


def check_table(table: int) -> int:
    if table not in TABLES:
        raise ValueError(f"Unsupported translation table {table}; supported: {list(TABLES)}")
    return table


def supported_tables() -> list[int]:
    return list(TABLES)


def table_name(table: int) -> str:
    return NAMES[check_table(table)]


def codons(table: int) -> dict[str, str]:
    """Codon to amino acid, `*` for stop."""
    every = [a + b + c for a in BASES for b in BASES for c in BASES]
    return dict(zip(every, STANDARD, strict=True)) | REASSIGNED[check_table(table)]


def stop_codons(table: int) -> list[str]:
    return sorted(c for c, aa in codons(table).items() if aa == "*")


def start_codons(table: int) -> list[str]:
    return list(STARTS[check_table(table)])


def caller_starts(table: int) -> list[str]:
    """Starts that gene calling uses: tables 1 and 11 have a shorter set there."""
    return list(CALLER_STARTS) if check_table(table) in (1, 11) else start_codons(table)


def start_weights(table: int) -> dict[str, float]:
    raw = {c: START_WEIGHTS.get(c, 1.0) for c in caller_starts(table)}
    return {c: w / max(raw.values()) for c, w in raw.items()}


def start_weight(codon: Column, table: int) -> Column:
    out = F.lit(1.0)
    for c, w in start_weights(table).items():
        out = F.when(codon == c, F.lit(w)).otherwise(out)
    return out


def genetic_code(spark: SparkSession) -> DataFrame:
    """384 rows: table, codon, aa, is_stop, is_start, is_caller_start, start_weight."""
    rows = []
    for t in TABLES:
        weights = start_weights(t)
        rows += [(t, c, aa, aa == "*", c in STARTS[t], c in caller_starts(t), weights.get(c, 1.0)) for c, aa in codons(t).items()]
    return spark.createDataFrame(rows, "table int, codon string, aa string, is_stop boolean, is_start boolean, is_caller_start boolean, start_weight double")
