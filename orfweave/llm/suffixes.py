"""Suffix-array dedup: bytes covered by strings of `LENGTH` bytes that also start elsewhere.

The suffixes that matter are few, so the corpus is first cut down to them, exactly:

1. In each string of LENGTH bytes the `GRAM`-byte piece with the smallest hash (the rightmost of equals) is its mark. Equal
   strings have equal marks, so only strings whose mark occurs twice can repeat. Strings with one mark overlap and form
   its context, at most 2 LENGTH - GRAM bytes.
2. Equal contexts are one, with a count. A mark with one context has no further suffixes to sort: all strings of a
   context that occurs twice repeat. Contexts are told apart by 128 bits of BLAKE2 over all their bytes.
3. The contexts of marks that have several are texts whose suffixes are sorted by the difference-cover algorithm:
   suffixes at places 1 and 2 modulo 3 are sorted by triples, named, and sorted by recursion on the names; the others
   are sorted by their first symbol and the next rank, and merged in. Neighbours in that order are compared by their
   first LENGTH bytes. Marks partition the suffixes, so tasks sort whole marks, in blocks of about `BLOCK` bytes.
4. A mark with more than `MANY` contexts is split by more bytes. In a string the mark begins at a place d of 0 to GRAM; two
   strings whose places are in one range of `STEP` agree on all but STEP - 1 bytes at their ends. Each range is a group of
   its own for each such middle, and is sorted as in 3. A group that still has more than MANY texts holds nearly equal
   strings: there the strings themselves, of LENGTH bytes, are counted, each task its own first. Groups only decide which
   texts are sorted together; bytes decide what repeats.

Repeats go back to documents through joins on (mark, context), salted where a mark has very many places, and a document's
spans are merged in its own row.

Defined results: null texts are empty; texts shorter than LENGTH never match; nothing crosses documents; equal rows
repeat one another; rows that share an id with different texts would get each other's spans, so ids must be distinct but
for equal rows. One very long text is cut into parts that share their borders, so memory follows the parts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import byte_codes, hot_keys, mix64, salted_join, stored, table, tidy

LENGTH, GRAM = 200, 100
BLOCK, MANY, STEP = 1 << 20, 2000, 8
PART = 1 << 22
_CODES = byte_codes(9)
_R = np.uint64(0xD1342543DE82EF95)
_R_INVERSE = np.uint64(pow(0xD1342543DE82EF95, -1, 1 << 64))


class _Powers:
    up = down = np.ones(1, np.uint64)

    @classmethod
    def upto(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            grown = []
            for base in (_R, _R_INVERSE):
                out = np.full(max(n, 1 << 17), base, np.uint64)
                out[0] = 1
                grown.append(np.multiply.accumulate(out))
            cls.up, cls.down = grown
        return cls.up, cls.down


def _sums(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    up, down = _Powers.upto(len(raw) + 1)
    return np.concatenate([np.zeros(1, np.uint64), np.cumsum(_CODES[raw] * up[: len(raw)], dtype=np.uint64)]), down


def _grams(raw: np.ndarray) -> np.ndarray:
    """A hash of the GRAM bytes from each position, the same wherever they lie."""
    sums, down = _sums(raw)
    n = len(raw) - GRAM + 1
    return mix64((sums[GRAM:] - sums[:-GRAM]) * down[:n])


def marks(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a text: for each mark its hash, its context's digest (two numbers), and the first and last start of its strings."""
    grams = _grams(raw)
    # Smallest hash of each window, with the place in its low bits so that the rightmost of equals is taken.
    low = np.uint64((1 << 23) - 1)
    best = (grams & ~low) | (low - np.arange(len(grams), dtype=np.uint64))
    width, span = LENGTH - GRAM + 1, 1
    while 2 * span <= width:
        best = np.minimum(best[:-span], best[span:])
        span *= 2
    if span < width:
        best = np.minimum(best[: span - width], best[width - span :])
    at = (low - (best & low)).astype(np.int64)
    first = np.concatenate([[0], np.flatnonzero(np.diff(at)) + 1])
    last = np.concatenate([first[1:], [len(at)]]) - 1
    place = at[first]
    data = raw.tobytes()
    # The mark's place is a part of its context: the same bytes around another place have other strings.
    digests = [hashlib.blake2b(data[a : b + LENGTH], digest_size=16, salt=(p - a).to_bytes(2, "little")).digest() for a, b, p in zip(first.tolist(), last.tolist(), place.tolist(), strict=True)]
    return grams[place], np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2), first, last


def _parts(raw: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Starts and parts of a text, so that each string of LENGTH bytes is in one part."""
    for start in range(0, max(1, len(raw) - LENGTH + 1), PART):
        yield start, raw[start : start + PART + LENGTH - 1]


KEY = ("mark", "context", "check")
_KEYS = "mark long, context long, check long"


def anchors(docs: DataFrame) -> DataFrame:
    """(mark, context, check, doc, start, extra): the strings of `mark` in `doc` start at start ... start + extra."""
    names = [*KEY, "doc", "start", "extra"]

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, 512):
                part = batch.slice(begin, 512)
                columns: list[list[np.ndarray]] = [[] for _ in names]
                for doc, text in zip(part["doc_id"].to_pylist(), part["text"].cast(pa.binary()).to_pylist(), strict=True):
                    if text is None or len(text) < LENGTH:
                        continue
                    for offset, raw in _parts(np.frombuffer(text, np.uint8)):
                        mark, digest, first, last = marks(raw)
                        for c, v in zip(columns, (mark.view(np.int64), digest[:, 0], digest[:, 1], np.full(len(mark), doc), first + offset, last - first), strict=True):
                            c.append(v)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, np.int64), *c])) for c in columns], names)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(tidy(made), ", ".join(f"{n} long" for n in names))


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Starts of all suffixes of text (non-negative numbers below 2**21) in order, by the difference-cover algorithm."""
    n = len(text)
    if n < 3:
        return np.array(sorted(range(n), key=lambda i: text[i:].tolist()), np.int64)
    padded = np.concatenate([text.astype(np.int64) + 1, np.zeros(3, np.int64)])
    # Sampled places; one more of class 1, past the end, keeps the two classes apart in the recursion.
    one = np.arange(1, n + (n % 3 == 1), 3)
    two = np.arange(2, n, 3)
    sample = np.concatenate([one, two])
    triples = (padded[sample] << 42) | (padded[sample + 1] << 21) | padded[sample + 2]
    order = np.argsort(triples, kind="stable")
    sorted_triples = triples[order]
    names_sorted = np.concatenate([[0], np.cumsum(sorted_triples[1:] != sorted_triples[:-1])])
    if names_sorted[-1] + 1 < len(sample):
        names = np.empty(len(sample), np.int64)
        names[order] = names_sorted
        order = suffix_array(names)
    by_rank = sample[order]
    rank = np.zeros(n + 3, np.int64)
    rank[by_rank] = np.arange(1, len(sample) + 1)
    by_rank = by_rank[by_rank < n]
    zero = np.arange(0, n, 3)
    pair = (padded[zero] << 21) | rank[zero + 1]
    zero = zero[np.argsort(pair, kind="stable")]
    # A suffix of class 0 is placed among those of class 1 by one symbol and a rank, among class 2 by two and a rank.
    ones, twos = by_rank[by_rank % 3 == 1], by_rank[by_rank % 3 == 2]
    less = np.searchsorted((padded[ones] << 21) | rank[ones + 1], (padded[zero] << 21) | rank[zero + 1])
    less += np.searchsorted((padded[twos] << 42) | (padded[twos + 1] << 21) | rank[twos + 2], (padded[zero] << 42) | (padded[zero + 1] << 21) | rank[zero + 2])
    out = np.empty(n, np.int64)
    spots = np.arange(len(zero)) + less
    taken = np.zeros(n, bool)
    taken[spots] = True
    out[spots] = zero
    out[~taken] = by_rank
    return out


def repeated_starts(texts: list[bytes], length: int = LENGTH) -> list[np.ndarray]:
    """For each text, where strings of `length` bytes start that start elsewhere in texts, too."""
    sizes = np.array([len(t) for t in texts])
    starts = np.concatenate([[0], np.cumsum(sizes + 1)])
    raw = np.frombuffer(b"\0".join(texts) + b"\0", np.uint8)
    symbols = raw.astype(np.int64) + 1
    symbols[starts[1:] - 1] = 0
    room = np.repeat(starts[1:] - 1, sizes + 1) - np.arange(len(raw))
    order = suffix_array(symbols)
    order = order[room[order] >= length]
    found = np.zeros(len(raw), bool)
    views = np.lib.stride_tricks.sliding_window_view(np.concatenate([raw, np.zeros(-length % 8, np.uint8)]), length)
    for i in range(0, len(order) - 1, 1 << 16):
        a, b = order[i : i + (1 << 16)], order[i + 1 : i + 1 + (1 << 16)]
        a = a[: len(b)]
        # Most neighbours differ at once or at the end: those are settled by two symbols.
        near = np.flatnonzero((raw[a] == raw[b]) & (raw[a + length - 1] == raw[b + length - 1]) & (raw[a + length // 2] == raw[b + length // 2]))
        same = near[(views[a[near]] == views[b[near]]).all(1)]
        found[a[same]] = True
        found[b[same]] = True
    return [np.flatnonzero(found[a : b - 1]) for a, b in zip(starts[:-1], starts[1:], strict=True)]


def _runs(starts: np.ndarray) -> list[int]:
    """Sorted numbers as runs: first, last, first, last, ..."""
    if not len(starts):
        return []
    cut = np.flatnonzero(np.diff(starts) > 1)
    return np.stack([starts[np.concatenate([[0], cut + 1])], starts[np.concatenate([cut, [len(starts) - 1]])]], 1).ravel().tolist()


GROUPED = f"grp long, {_KEYS}, base int, text binary"
RUNS = f"{_KEYS}, runs array<int>"


def sorted_contexts(texts: DataFrame) -> DataFrame:
    """(mark, context, check, runs) from GROUPED rows: starts that repeat among the texts of a group, as runs; base is
    where a text begins in its context. Rows of a group follow one another in one partition."""

    def solve(rows: list[tuple]) -> pa.RecordBatch:
        found = repeated_starts([r[-1] for r in rows])
        columns = [pa.array([r[i] for r in rows], pa.int64()) for i in (1, 2, 3)]
        return pa.RecordBatch.from_arrays([*columns, pa.array([_runs(f + r[4]) for f, r in zip(found, rows, strict=True)], pa.list_(pa.int32()))], [*KEY, "runs"])

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size, begun = 0, None
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row[0] != begun and size > BLOCK // 4:
                    yield solve(held)
                    held, size = [], 0
                begun = row[0]
                held.append(row)
                size += len(row[-1]) + 1
        if held:
            yield solve(held)

    return texts.select(*(f.split(" ")[0] for f in GROUPED.split(", "))).mapInArrow(tidy(made), RUNS)


def split_contexts(texts: DataFrame) -> DataFrame:
    """GROUPED rows of contexts (mark, context, check, text): the strings whose mark begins in one range of STEP places, in
    one group if they agree on the bytes that all of these have."""

    def pieces(mark: int, text: bytes) -> Iterator[tuple[int, int, bytes]]:
        extra = len(text) - LENGTH
        same = np.flatnonzero(_grams(np.frombuffer(text, np.uint8))[: LENGTH - GRAM + 1].view(np.int64) == mark)
        place = int(same[-1])
        for low in range(max(0, place - extra) // STEP * STEP, place + 1, STEP):
            high = min(low + STEP - 1, LENGTH - GRAM)
            first, last = max(0, place - high), min(extra, place - low)
            if first <= last:
                middle = text[place - low : place + LENGTH - high]
                key = hashlib.blake2b(middle, digest_size=8, salt=low.to_bytes(2, "little")).digest()
                yield int.from_bytes(key, "little", signed=True) ^ mark, first, text[first : last + LENGTH]

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, 512):
                part = batch.slice(begin, 512)
                rows, out = [], ([], [], [])
                for i, (mark, text) in enumerate(zip(part["mark"].to_pylist(), part["text"].to_pylist(), strict=True)):
                    for piece in pieces(mark, text):
                        rows.append(i)
                        for column, value in zip(out, piece, strict=True):
                            column.append(value)
                at = pa.array(rows, pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), *(part[k].take(at) for k in KEY), pa.array(out[1], pa.int32()), pa.array(out[2], pa.binary())], ["grp", *KEY, "base", "text"])

    return texts.select(*KEY, "text").mapInArrow(tidy(made), GROUPED)


def grouped_runs(texts: DataFrame, parts: int) -> DataFrame:
    """(mark, context, check, runs) of GROUPED rows of any group size: sorted, or counted as whole strings in groups of
    more than MANY."""
    sizes = stored(texts.groupBy("grp").agg(F.count("*").alias("k")).where("k > 1"), "sizes")
    hot = hot_keys(sizes, "grp", "k")
    met = salted_join(texts, sizes, ["grp"], hot, F.struct("context", "base"))
    few = sorted_contexts(met.where(F.col("k") <= MANY).repartition(parts, "grp").sortWithinPartitions("grp"))
    at = F.explode(F.sequence(F.lit(1), F.octet_length("text") - (LENGTH - 1)))
    strings = met.where(F.col("k") > MANY).select(*KEY, "base", "text", at.alias("i"))
    strings = strings.select(*KEY, F.substring("text", F.col("i"), F.lit(LENGTH)).alias("text"), (F.col("base") + F.col("i") - 1).alias("at")).withColumn("key", F.xxhash64("text"))
    twice = strings.groupBy("key", "text").agg(F.count("*").alias("n")).where("n > 1")
    twice = stored(twice, "strings")
    many = salted_join(strings, twice.select("key", "text"), ["key", "text"], hot_keys(twice, "key"), F.struct("context", "at"), "left_semi")
    return few.where(F.size("runs") > 0).unionByName(many.select(*KEY, F.array("at", "at").cast("array<int>").alias("runs")))


def context_texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(mark, context, check, text) of wanted (mark, context, check, doc, start, extra), cut out of the documents."""
    by_doc = wanted.groupBy("doc").agg(F.collect_list(F.struct(*KEY, "start", "extra")).alias("cuts"))

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, 256):
                part = batch.slice(begin, 256)
                out: list[list] = [[], [], [], []]
                for text, cuts in zip(part["text"].cast(pa.binary()).to_pylist(), part["cuts"].to_pylist(), strict=True):
                    for cut in cuts:
                        piece = text[cut["start"] : cut["start"] + cut["extra"] + LENGTH]
                        for column, value in zip(out, (*(cut[k] for k in KEY), piece), strict=True):
                            column.append(value)
                yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in out[:3]), pa.array(out[3], pa.binary())], [*KEY, "text"])

    return docs.join(by_doc, F.col("doc_id") == F.col("doc")).select("text", "cuts").mapInArrow(tidy(made), _KEYS + ", text binary")


def repeats(docs: DataFrame) -> DataFrame:
    """(doc, spans): for each document with repeated strings their bytes as starts and ends, in turn, not merged."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    parts = max(8, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    every = anchors(docs)
    twice = stored(every.groupBy("mark").agg(F.count("*").alias("n")).where("n > 1"), "twice")
    hot, spread = hot_keys(twice, "mark"), F.struct("doc", "start")
    found = stored(salted_join(every, twice.select("mark"), ["mark"], hot, spread, "left_semi"), "marks")
    one = F.min(F.struct("doc", "start", "extra")).alias("one")
    contexts = stored(found.groupBy(*KEY).agg(F.count("*").alias("n"), one), "contexts")
    several = stored(contexts.groupBy("mark").agg(F.count("*").alias("k")).where("k > 1"), "several")
    # One context: all its strings repeat. Several: those of a context that occurs twice do, others are sorted.
    whole = contexts.where("n > 1").select(*KEY, F.array(F.lit(0), F.col("one.extra").cast("int")).alias("runs"))
    varied = salted_join(contexts, several, ["mark"], hot, F.col("context")).select(*KEY, "one.*")
    texts = stored(context_texts(docs, varied), "texts")
    texts = salted_join(texts, several, ["mark"], hot, F.col("context"))
    few = texts.where(F.col("k") <= MANY).select(F.col("mark").alias("grp"), *KEY, F.lit(0).alias("base"), "text")
    few = sorted_contexts(few.repartition(parts, "grp").sortWithinPartitions("grp")).where(F.size("runs") > 0)
    runs = whole.unionByName(few)
    if not several.where(F.col("k") > MANY).isEmpty():
        split = stored(split_contexts(texts.where(F.col("k") > MANY)), "split")
        runs = runs.unionByName(grouped_runs(split, parts))
    runs = stored(runs.groupBy(*KEY).agg(F.flatten(F.collect_list("runs")).alias("runs")), "runs")
    back = salted_join(found, runs, list(KEY), hot, spread)
    spans = F.transform("runs", lambda r, i: F.col("start") + r + F.when(i % 2 == 1, LENGTH).otherwise(0))
    return back.select("doc", spans.alias("spans")).groupBy("doc").agg(F.flatten(F.collect_list("spans")).alias("spans"))


DEDUPED = "doc_id long, n_bytes long, spans array<long>, kept binary"


def deduplicated(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, spans, kept): maximal removed runs as start, end, start, end, ..., and the bytes that stay."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, 256):
                part = batch.slice(begin, 256)
                out: list[list] = [[], [], []]
                for text, spans in zip(part["text"].cast(pa.binary()).to_pylist(), part["spans"].to_pylist(), strict=True):
                    text, merged, kept, at = text or b"", [], [], 0
                    for a, b in sorted(zip(spans[::2], spans[1::2], strict=True)) if spans else ():
                        if merged and a <= merged[-1]:
                            merged[-1] = max(merged[-1], b)
                        else:
                            merged += [a, b]
                    for a, b in zip(merged[::2], merged[1::2], strict=True):
                        kept.append(text[at:a])
                        at = b
                    kept.append(text[at:])
                    for column, value in zip(out, (len(text), merged, b"".join(kept)), strict=True):
                        column.append(value)
                yield pa.RecordBatch.from_arrays([part["doc_id"], pa.array(out[0], pa.int64()), pa.array(out[1], pa.list_(pa.int64())), pa.array(out[2], pa.binary())], ["doc_id", "n_bytes", "spans", "kept"])

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return docs.join(repeats(docs), F.col("doc_id") == F.col("doc"), "left").select("doc_id", "text", "spans").mapInArrow(tidy(made), DEDUPED)


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = deduplicated(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).cast("long").alias("n_removed"), F.floor(F.size("spans") / 2).cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
