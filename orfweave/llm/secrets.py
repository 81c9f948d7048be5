"""Secret scans with DataFrame functions only.

Base spans come from three fixed patterns. The method adds tokens that look random: two character Markov models, one of
random strings and one of ordinary identifiers, give each token a log-likelihood ratio; a high mean ratio per character
over enough characters makes the token a span of kind `markov`. Where base spans cover a part of a token, each part that
they leave and that has enough characters is scored by itself. Spans are in code points, the end exclusive.

Training: ordinary identifiers are the words of at most `TRAIN_DOCS` documents (those with the smallest hashed ids),
labelled ordinary where no base pattern matches; random strings are `TRAIN_RANDOM` generated digests in hexadecimal and
base64. Only counts of character pairs, at most 68 x 68 of them, reach the driver.

Defined results: a null text is empty and has no spans; equal rows give equal results; an empty table gives no rows (its
model is then trained on generated strings only). Positions are taken from the pieces between matches, so one very long
text costs time in proportion to its length. Nothing is shuffled but the training counts.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import let, table

#: Fixed patterns of the base spans, in the order of their kinds: pattern, least length, group that has that length.
KINDS = ("assign", "access", "hex", "markov")
ASSIGN = (
    r"""(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
#: Runs are maximal, so asking for their least length in the pattern finds what dropping short runs leaves.
ACCESS = r"(AKIA[A-Z0-9]{16,})"
HEX = r"(?<![0-9a-f])([0-9a-f]{24,})"
PATTERNS = ((ASSIGN, 6), (ACCESS, 20), (HEX, 24))

#: Characters of tokens; every other character is the last state.
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-."
STATES = len(ALPHABET) + 1
#: A token that the models score: this many of these characters or more.
LEAST = 20
TOKEN = rf"(?<![A-Za-z0-9+/_=-])([A-Za-z0-9+/_=-]{{{LEAST},}})"
TRAIN_DOCS = 500
TRAIN_RANDOM = 2000
#: Mean log-likelihood ratio per character pair from which on a token is random.
THRESHOLD = 0.8
SMOOTH = 0.5


def matches(text: Column, pattern: str, least: int, kind: str) -> Column:
    """Leftmost non-overlapping matches whose group 1 has `least` characters or more, as structs (s, e, k)."""

    def placed(found: Column) -> Column:
        def step(acc: Column, i: Column) -> Column:
            start = acc["at"] + F.length(F.get(found["gaps"], i))
            end = start + F.length(F.get(found["all"], i))
            hit = F.struct(start.alias("s"), end.alias("e"), F.lit(KINDS.index(kind)).alias("k"))
            return F.struct(end.alias("at"), F.when(F.length(F.get(found["group"], i)) >= least, F.concat(acc["out"], F.array(hit))).otherwise(acc["out"]).alias("out"))

        zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<s:int,e:int,k:int>>").alias("out"))
        return F.aggregate(F.sequence(F.lit(0), F.size(found["all"]) - 1), zero, step, lambda acc: acc["out"])

    found = F.struct(F.split(text, pattern, -1).alias("gaps"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("all"), F.regexp_extract_all(text, F.lit(pattern), F.lit(1)).alias("group"))
    return F.when(text.rlike(pattern), let(found, placed)).otherwise(F.array().cast("array<struct<s:int,e:int,k:int>>"))


def pair_counts(strings: DataFrame) -> list[list[float]]:
    """Counts of adjacent character states over the column w of strings; at most STATES x STATES rows are collected."""
    at = F.explode(F.sequence(F.lit(1), F.length("w") - 1))
    pairs = strings.where(F.length("w") > 1).select("w", at.alias("i")).select(F.substring(F.col("w"), F.col("i"), F.lit(2)).alias("p")).groupBy("p").count()
    found = pairs.select(_state(F.substring("p", 1, 1)).alias("a"), _state(F.substring("p", 2, 1)).alias("b"), "count").groupBy("a", "b").agg(F.sum("count").alias("n"))
    out = [[0.0] * STATES for _ in range(STATES)]
    for r in found.collect():
        out[r["a"]][r["b"]] = float(r["n"])
    return out


def _state(char: Column) -> Column:
    """Number of a character's state. The alphabet is searched for the character."""
    at = F.call_function("locate", char, F.lit(ALPHABET))
    return F.when(at > 0, at - 1).otherwise(F.lit(STATES - 1))


def training_strings(docs: DataFrame, train_docs: int = TRAIN_DOCS, train_random: int = TRAIN_RANDOM) -> DataFrame:
    """The labelled sample: rows (w, random). Bounded by train_docs documents and train_random seeds."""
    spark = docs.sparkSession
    ids = docs.select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_docs)
    text = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(ids.distinct()), "doc_id", "left_semi")
    plain = text.select(F.explode(F.split("text", r"[^A-Za-z0-9+/_=\p{L}-]+")).alias("w")).where((F.length("w") >= 4) & ~F.col("w").rlike(f"{HEX}|{ACCESS}|[0-9]{{4,}}"))
    seeds = spark.range(train_random).select(F.sha2(F.concat(F.lit("seed"), F.col("id").cast("string")), 256).alias("x"))
    made = seeds.select(F.explode(F.array("x", F.regexp_replace(F.base64(F.unhex("x")).cast("string"), "=", ""), F.upper("x"))).alias("w"))
    return plain.withColumn("random", F.lit(False)).unionByName(made.withColumn("random", F.lit(True)))


def train(docs: DataFrame, train_docs: int = TRAIN_DOCS, train_random: int = TRAIN_RANDOM) -> list[float]:
    """Log ratios ln P(b | a, random) - ln P(b | a, ordinary) for all pairs of states, row by row."""
    sample = training_strings(docs, train_docs, train_random)
    tables = []
    for random in (True, False):
        counts = pair_counts(sample.where(F.col("random") == random).select("w"))
        tables.append([[math.log((n + SMOOTH) / (sum(row) + SMOOTH * STATES)) for n in row] for row in counts])
    return [round(a - b, 6) for x, y in zip(*tables, strict=True) for a, b in zip(x, y, strict=True)]


def mean_ratio(token: Column, ratios: list[float]) -> Column:
    """Mean log-likelihood ratio of the character pairs of a token."""
    lookup = F.lit(ratios)

    def summed(states: Column) -> Column:
        steps = F.sequence(F.lit(1), F.size(states) - 1)
        total = F.aggregate(steps, F.lit(0.0), lambda a, i: a + F.get(lookup, F.get(states, i - 1) * STATES + F.get(states, i)))
        return total / (F.size(states) - 1)

    return let(F.transform(F.filter(F.split(token, ""), lambda c: c != ""), _state), summed)


def scan(df: DataFrame, ratios: list[float], text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """row (a struct of all columns of df, so that no name can clash), text (null: empty), and base_spans and spans: arrays
    of structs (s, e, k), k a place in KINDS, sorted by start and kind."""
    kind = "array<struct<s:int,e:int,k:int>>"
    t = F.col("text")
    out = df.select(F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("row"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    out = out.withColumn("base_spans", F.array_sort(F.concat(*(matches(t, p, least, k) for (p, least), k in zip(PATTERNS, KINDS, strict=False)))))

    def left(x: Column) -> Column:
        """The parts of a token that no base span covers."""

        def step(acc: Column, b: Column) -> Column:
            meets = (b["s"] < x["e"]) & (acc["at"] < b["e"])
            part = F.struct(acc["at"].alias("s"), b["s"].alias("e"), x["k"].alias("k"))
            out = F.when(meets & (acc["at"] < b["s"]), F.concat(acc["out"], F.array(part))).otherwise(acc["out"])
            return F.struct(F.when(meets, b["e"]).otherwise(acc["at"]).alias("at"), out.alias("out"))

        zero = F.struct(x["s"].alias("at"), F.array().cast(kind).alias("out"))
        last = lambda acc: F.concat(acc["out"], F.array(F.struct(acc["at"].alias("s"), x["e"].alias("e"), x["k"].alias("k"))))
        return F.aggregate(F.col("base_spans"), zero, step, last)

    def random_ones(found: Column) -> Column:
        parts = F.filter(F.flatten(F.transform(found, left)), lambda x: x["e"] - x["s"] >= LEAST)
        return F.filter(parts, lambda x: mean_ratio(F.substring(t, x["s"] + 1, x["e"] - x["s"]), ratios) >= threshold)

    added = F.when(t.rlike(TOKEN), let(matches(t, TOKEN, LEAST, "markov"), random_ones)).otherwise(F.array().cast(kind))
    return out.withColumn("spans", F.array_sort(F.concat("base_spans", added)))


def written(spans: Column) -> Column:
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["k"]), x["s"].cast("string"), x["e"].cast("string"))), ",")


def masked(text: Column, spans: Column) -> Column:
    """The text with each span (overlapping ones as one) replaced by `[SECRET]`."""

    def step(acc: Column, x: Column) -> Column:
        return (
            F.when(x["s"] >= acc["at"], F.struct(x["e"].alias("at"), F.concat(acc["out"], F.substring(text, acc["at"] + 1, x["s"] - acc["at"]), F.lit("[SECRET]")).alias("out")))
            .otherwise(F.struct(F.greatest(acc["at"], x["e"]).alias("at"), acc["out"].alias("out")))
        )

    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    whole = F.aggregate(spans, zero, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))
    return F.when(F.size(spans) > 0, whole).otherwise(text)


def op8_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = scan(docs, train(docs)).select("row.doc_id", "base_spans", "spans")
    n = lambda k: F.size(F.filter("base_spans", lambda x: x["k"] == KINDS.index(k))).cast("long").alias(f"n_{k}")
    return found.select("doc_id", n("assign"), n("access"), n("hex"), F.sha2(written(F.col("base_spans")), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"))
