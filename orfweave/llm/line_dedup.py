"""Line dedup by winnowing.

Lines with a word are hashed. Of each window of `RUN` such lines the one with the smallest hash (the rightmost of equals)
is selected; each selected line is a fingerprint, so any run of RUN lines that repeats shares a fingerprint at the same
place. Only fingerprints leave the documents: the line's hash, its position, and the hashes of the lines around it.

1. Fingerprints whose hash occurs at several positions are joined by it; all others are dropped.
2. A match is extended both ways from the fingerprint, over the lines before and after it that its windows hold.
3. Of equal runs the one that comes first, in order of (doc_id, line), stays. Lines of later ones go; runs that overlap or
   follow one another make up longer ones, of any length.

A run is RUN lines; or one line, or two consecutive ones, of `LONG` words or more together; or all lines of a document that
has fewer than RUN (compared with other such documents). Lines without a word are no part of runs: they are never counted,
matched or removed, and the lines on either side of them are consecutive.

Defined results: null texts are empty and stay null; a run that repeats within its own document goes there too, and where
it overlaps its first occurrence only the lines beyond that go; a document may become empty and stays as a row; of equal
texts with different ids the smallest id keeps its lines; rows that repeat an id are one document to this operator (each
must have an id of its own to be compared with the others); other columns pass through, and the result adds `__removed`.
Runs are told apart by the 64-bit hashes of all their lines (128 bits for one line alone).

Shuffled rows have a fixed size and are aggregated in each task first; joins are salted where a line is so frequent that its
rows would fill a task. A document's own removed lines are the largest group.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import hot_keys, salted_join, stored, table, tidy

RUN, LONG = 3, 50
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: kinds: bits of the runs that select the fingerprint (0 to 2: its place in a window; 3, 4: its place in a pair of lines; 5:
#: the line alone; 6: the whole document). lines and hashes: the fingerprint in the middle of its four neighbours.
MARKS = "doc_id long, mark long, more long, kinds int, lines array<int>, hashes array<long>"
_NONE = -1


def fingerprints(hashes: list[int], run: int = RUN) -> list[int]:
    """For each window of `run` hashes, the place of its smallest, the rightmost of equals."""
    return [min(range(i, i + run), key=lambda j: (hashes[j], -j)) for i in range(len(hashes) - run + 1)]


def selected(hashes: list[int], sizes: list[int]) -> dict[int, int]:
    """The selected places among a document's lines (their hashes and numbers of words), with their kinds."""
    kinds: dict[int, int] = {}

    def select(place: int, bit: int) -> None:
        kinds[place] = kinds.get(place, 0) | 1 << bit

    for i, j in enumerate(fingerprints(hashes)):
        select(j, j - i)
    for i, j in enumerate(fingerprints(hashes, 2)):
        if sizes[i] + sizes[i + 1] >= LONG:
            select(j, 3 + j - i)
    for i, size in enumerate(sizes):
        if size >= LONG:
            select(i, 5)
    if 0 < len(hashes) < RUN:
        select(fingerprints(hashes, len(hashes))[0], 6)
    return kinds


def marks(docs: DataFrame) -> DataFrame:
    """A row for each fingerprint of each document."""
    kinds_of = [f.split(" ")[0] for f in MARKS.split(", ")]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int32()), pa.list_(pa.int64())]

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (b.slice(start, 512) for b in batches for start in range(0, b.num_rows, 512)):
            out: list[list] = [[] for _ in types]
            for doc_id, text in zip(part["doc_id"].to_pylist(), part["text"].to_pylist(), strict=True):
                at, low, high, sizes = [_NONE] * 2, [0] * 2, [0] * 2, []
                for i, line in enumerate((text or "").split("\n")):
                    if n := len(_WORD.findall(line)):
                        both = xxhash.xxh3_128_intdigest(line.encode())
                        at.append(i)
                        low.append((both & (1 << 64) - 1) - (1 << 63))
                        high.append((both >> 64) - (1 << 63))
                        sizes.append(n)
                at += [_NONE] * 2
                low += [0] * 2
                for j, kinds in selected(low[2:-2], sizes).items():
                    for column, value in zip(out, (doc_id, low[j + 2], high[j + 2], kinds, at[j : j + 5], low[j : j + 5]), strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], kinds_of)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(tidy(made), MARKS)


def runs(found: DataFrame) -> DataFrame:
    """(mark, run, doc_id, lines): fingerprints extended both ways to the runs that select them. run tells runs apart: the
    kind (windows, pairs, lines, documents) and the hashes of all lines."""
    has = lambda bit: F.col("kinds").bitwiseAND(1 << bit) != 0

    def part(kind: str, first: int, n: int, condition: Column) -> Column:
        lines, hashes = F.slice("lines", first + 1, n), F.slice("hashes", first + 1, n)
        if kind == "line":
            hashes = F.array("mark", "more")
        run = F.struct(F.lit(kind).alias("kind"), hashes.alias("hashes"))
        return F.when(condition, F.struct(run.alias("run"), lines.alias("lines")))

    some = [part("window", 2 - place, RUN, has(place)) for place in range(RUN)]
    some += [part("pair", 2 - place, 2, has(3 + place)) for place in range(2)]
    some += [part("line", 2, 1, has(5))]
    # A short document: its one line, or the fingerprint with the line before or after it.
    before, after = F.col("lines")[1] != _NONE, F.col("lines")[3] != _NONE
    some += [part("document", 2, 1, has(6) & ~before & ~after), part("document", 1, 2, has(6) & before), part("document", 2, 2, has(6) & after)]
    each = found.select("mark", "doc_id", F.explode(F.filter(F.array(*some), lambda x: x.isNotNull())).alias("x"))
    return each.select("mark", "x.run", "doc_id", "x.lines")


def repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, lines): numbers of the lines of each document that later repeated runs hold, sorted."""
    every = stored(marks(docs), "marks")
    place = F.struct("doc_id", F.col("lines")[2])
    shared = every.groupBy("mark").agg(F.min(place).alias("a"), F.max(place).alias("b"), F.count("*").alias("n")).where("a <> b").select("mark", "n")
    shared = stored(shared, "shared")
    hot = hot_keys(shared, "mark")
    # Like all joins here it has one plan at every size, as both sides grow with the corpus.
    matched = runs(salted_join(every, shared.select("mark").hint("merge"), ["mark"], hot, F.struct("doc_id", "lines"), "left_semi"))
    at = F.struct("doc_id", F.col("lines")[0].alias("line"), F.element_at("lines", -1).alias("last"))
    first = matched.groupBy("mark", "run").agg(F.min(at).alias("first"), F.max(at).alias("latest")).where("first <> latest").select("mark", "run", "first")
    later = salted_join(matched, first.hint("merge"), ["mark", "run"], hot, F.struct("doc_id", "lines")).where((F.col("doc_id") != F.col("first.doc_id")) | (F.col("lines")[0] != F.col("first.line")))
    # A run that overlaps its own first occurrence loses what lies beyond that.
    kept = lambda n: (F.col("doc_id") == F.col("first.doc_id")) & (n <= F.col("first.last"))
    gone = later.select("doc_id", F.explode(F.filter("lines", lambda n: ~kept(n))).alias("n")).distinct()
    return gone.groupBy("doc_id").agg(F.sort_array(F.collect_list("n")).alias("lines"))


def without_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches with the column text rewritten by the column __removed."""
    for batch in (b.slice(start, 512) for b in batches for start in range(0, b.num_rows, 512)):
        texts = batch["text"].to_pylist()
        for i, gone in enumerate(batch["__removed"].to_pylist()):
            if gone:
                drop = set(gone)
                texts[i] = "\n".join(x for n, x in enumerate(texts[i].split("\n")) if n not in drop)
        yield batch.set_column(batch.schema.get_field_index("text"), "text", pa.array(texts, batch.schema.field("text").type))


def deduplicated(docs: DataFrame) -> DataFrame:
    """docs, text less its removed lines, with the column __removed (their numbers, null if none) added."""
    gone = repeats(docs.select("doc_id", "text")).select(F.col("doc_id").alias("__id"), F.col("lines").alias("__removed"))
    # One plan at every size: what is removed grows with the corpus, so it is never sent to all tasks.
    joined = docs.join(gone.hint("merge"), F.col("doc_id") == F.col("__id"), "left").drop("__id")
    return joined.mapInArrow(tidy(without_lines), joined.schema)


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.size(F.split(F.coalesce("text", F.lit("")), "\n", -1)).cast("long").alias("n_lines"))
    out = deduplicated(docs)
    return out.select("doc_id", "n_lines", F.coalesce(F.size("__removed"), F.lit(0)).cast("long").alias("n_removed"), F.length("text").cast("long").alias("kept_chars"), F.sha2("text", 256).alias("kept_sha256"))


OP2_SQL = rf"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
a AS (SELECT doc_id, unnest(ls) AS x, unnest(range(len(ls))) AS i FROM d),
b AS (SELECT *, len(regexp_extract_all(x, '[^\x20\x09-\x0D]+')) AS c FROM a WHERE regexp_matches(x, '[^\x20\x09-\x0D]')),
l AS (SELECT *, row_number() OVER o AS k, count(*) OVER (PARTITION BY doc_id) AS size, lead(x) OVER o AS x1, lead(i) OVER o AS i1, lead(c) OVER o AS c1,
    lead(x, 2) OVER o AS x2, lead(i, 2) OVER o AS i2 FROM b WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
w AS (SELECT doc_id, i, i2 AS z, [i, i1, i2] AS n, 'window' || x || chr(10) || x1 || chr(10) || x2 AS g FROM l WHERE x2 IS NOT NULL
    UNION ALL SELECT doc_id, i, i1, [i, i1], 'pair' || x || chr(10) || x1 FROM l WHERE c + c1 >= {LONG}
    UNION ALL SELECT doc_id, i, i, [i], 'line' || x FROM l WHERE c >= {LONG}
    UNION ALL SELECT doc_id, i, coalesce(i1, i), CASE WHEN i1 IS NULL THEN [i] ELSE [i, i1] END, 'document' || x || coalesce(chr(10) || x1, '') FROM l WHERE size < {RUN} AND k = 1),
f AS (SELECT *, row_number() OVER o AS r, first_value(doc_id) OVER o AS fd, first_value(z) OVER o AS fz FROM w WINDOW o AS (PARTITION BY g ORDER BY doc_id, i)),
gone AS (SELECT DISTINCT doc_id, i FROM (SELECT doc_id, unnest(n) AS i, fd, fz FROM f WHERE r > 1) WHERE doc_id <> fd OR i > fz),
k AS (SELECT a.doc_id, string_agg(a.x, chr(10) ORDER BY a.i) FILTER (gone.i IS NULL) AS t, count(gone.i) AS c FROM a LEFT JOIN gone ON a.doc_id = gone.doc_id AND a.i = gone.i GROUP BY a.doc_id)
SELECT d.doc_id, CAST(len(ls) AS BIGINT) AS n_lines, CAST(c AS BIGINT) AS n_removed, CAST(length(coalesce(t, '')) AS BIGINT) AS kept_chars, sha256(coalesce(t, '')) AS kept_sha256 FROM d JOIN k USING (doc_id)
"""
