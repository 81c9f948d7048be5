"""Packing along a space-filling curve.

Each document's token ids are hashed to a signed vector, projected to three dimensions, and given the place of its cell
on a Hilbert curve. Documents are range-sorted by (place, id), so that neighbours on the curve meet in a partition, and
each partition lays its documents end to end in sequences of `size` tokens, cutting documents where a sequence ends.
Only the last sequence of a partition is padded.

Token ids are made once and written, with the curve's place, to the shared folder; the sort reads them from there.
Defined results: a null text is empty and becomes the end token alone; copies have one place and are ordered by id (the
range sort splits them by id, so no partition holds a whole hot group); equal (id, text) rows are each packed; an empty
table gives no rows. A task holds one batch of documents, however long its partition is.
"""

from __future__ import annotations

import base64
import functools
import re
import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import byte_codes, mix64, stored, table, tidy

SIZE = 2048
END = 1
#: Tokens that a partition should hold; the number of partitions follows from the corpus.
PARTITION_TOKENS = 4_000_000
BUCKETS, DIMS, BITS = 256, 3, 10
#: Words whose ids a Python worker remembers, in each of two generations.
CACHE = 200_000
TOKENS = "doc_id long, place long, n_tokens long, ids binary"
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def default_tokenizer() -> tuple[str, str]:
    """The tokenizer's definition, and its vocabulary as ranks."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


@functools.lru_cache(maxsize=2)
def encoder(paths: tuple[str, str]) -> Callable[[str], np.ndarray]:
    """A function from a text without added tokens to its ids, as little-endian unsigned numbers of 16 bits (32 for large
    vocabularies).

    The definition in paths[0] says how texts are split; the ranks in paths[1], whose ids are the same, do the merges.
    Where a text has single spaces only, the split never joins what such a space parts (a word takes its space along),
    so words can be looked up; other texts are encoded whole.
    """
    import json

    import tiktoken
    from public_tokenizers import PATTERN

    with open(paths[0], "rb") as f:
        spec = json.load(f)
    if spec["normalizer"] is not None or spec["pre_tokenizer"] != {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}:
        raise ValueError("not a byte-level tokenizer of the expected kind")
    with open(paths[1], "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    kind = "<u2" if max([len(ranks), *(t["id"] for t in spec["added_tokens"])]) < 1 << 16 else "<u4"
    ordinary = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    pack = {n: struct.Struct(f"<{n}{'H' if kind == '<u2' else 'I'}").pack for n in range(1, 17)}
    young: dict[str, bytes] = {}
    old: dict[str, bytes] = {}

    def fresh(text: str) -> bytes:
        ids = ordinary(text)
        return pack[len(ids)](*ids) if 0 < len(ids) < 17 else np.array(ids, dtype=kind).tobytes()

    def encode(text: str) -> np.ndarray:
        nonlocal young, old
        if "  " in text or text[:1] == " " or text[-1:] == " " or not text:
            return np.frombuffer(fresh(text), dtype=kind)
        head, _, rest = text.partition(" ")
        if not rest:
            return np.frombuffer(fresh(head), dtype=kind)
        words = rest.split(" ")
        found = list(map(young.get, words))
        if None in found:
            for i, x in enumerate(found):
                if x is None:
                    w = words[i]
                    found[i] = x = young.get(w) or old.get(w) or fresh(" " + w)
                    if len(w) <= 64:
                        young[w] = x
            if len(young) > CACHE:
                young, old = {}, young
        found.insert(0, fresh(head))
        return np.frombuffer(b"".join(found), dtype=kind)

    return encode


@functools.lru_cache(maxsize=2)
def whole_encoder(paths: tuple[str, str]) -> Callable[[str], np.ndarray]:
    """A function from any text to its ids: added tokens (the longest of those at a place) have ids of their own, and
    what lies between them is encoded by itself."""
    import json

    with open(paths[0], "rb") as f:
        added = json.load(f)["added_tokens"]
    if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in added):
        raise ValueError("not added tokens of the expected kind")
    ordinary = encoder(paths)
    if not added:
        return ordinary
    id_of = {t["content"]: t["id"] for t in added}
    parted = re.compile("(" + "|".join(map(re.escape, sorted(id_of, key=len, reverse=True))) + ")")

    def encode(text: str) -> np.ndarray:
        parts = parted.split(text)
        if len(parts) == 1:
            return ordinary(text)
        found = [ordinary(x) for x in parts[::2]]
        kind = found[0].dtype
        tokens = [np.array([id_of[x]], kind) for x in parts[1::2]]
        return np.concatenate([x for pair in zip(found, [*tokens, np.zeros(0, kind)], strict=True) for x in pair])

    return encode


def hilbert(cells: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Places on the Hilbert curve of points with integer coordinates below 2**bits (rows: points)."""
    x = [cells[:, i].astype(np.int64) for i in range(cells.shape[1])]
    n = len(x)
    # Undo the curve's rotations and reflections from the largest cells down, then read Gray code off the axes.
    for level in range(bits - 1, 0, -1):
        high, low = 1 << level, (1 << level) - 1
        for i in range(n):
            turned = (x[i] & high) != 0
            swap = np.where(turned, 0, (x[0] ^ x[i]) & low)
            x[0] = np.where(turned, x[0] ^ low, x[0] ^ swap)
            x[i] = x[i] ^ swap
    for i in range(1, n):
        x[i] ^= x[i - 1]
    flips = np.zeros_like(x[0])
    for level in range(bits - 1, 0, -1):
        flips = np.where((x[-1] & (1 << level)) != 0, flips ^ ((1 << level) - 1), flips)
    place = np.zeros_like(x[0])
    for level in range(bits - 1, -1, -1):
        for i in range(n):
            place = (place << 1) | (((x[i] ^ flips) >> level) & 1)
    return place


def projection(seed: int = 11) -> np.ndarray:
    """BUCKETS x DIMS numbers of unit scale by rule."""
    raw = mix64(np.arange(BUCKETS * DIMS, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))
    return (raw.astype(np.float64) / 2**63 - 1).reshape(BUCKETS, DIMS)


def token_buckets(vocabulary: int = 1 << 17) -> np.ndarray:
    """For each token id, twice its bucket, and one more if its sign is positive."""
    code = mix64(np.arange(vocabulary, dtype=np.uint64) + byte_codes(3)[0])
    return (code % np.uint64(2 * BUCKETS)).astype(np.int64)


def place_of(points: np.ndarray) -> np.ndarray:
    """Places of projected vectors of unit length: coordinates in [-1, 1] become cells."""
    cells = np.clip((points + 1) / 2 * (1 << BITS), 0, (1 << BITS) - 1).astype(np.int64)
    return hilbert(cells)


def tokenize(docs: DataFrame, paths: tuple[str, str]) -> DataFrame:
    """(doc_id, place, n_tokens, ids): ids as the encoder packs them, the end token included."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, buckets, scale = whole_encoder(paths), token_buckets(), projection()
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                ids, points = [], np.zeros((part.num_rows, DIMS))
                for i, text in enumerate(part["text"].to_pylist()):
                    found = encode(text or "")
                    counts = np.bincount(buckets[found], minlength=2 * BUCKETS)
                    sums = (counts[1::2] - counts[::2]) @ scale
                    points[i] = sums / max(np.linalg.norm(sums), 1e-12)
                    ids.append(np.append(found, found.dtype.type(END)))
                yield pa.RecordBatch.from_arrays([part["doc_id"], pa.array(place_of(points)), pa.array([len(x) for x in ids], pa.int64()), pa.array([x.tobytes() for x in ids], pa.binary())], ["doc_id", "place", "n_tokens", "ids"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(tidy(made), TOKENS)


def lay_out(tokens: DataFrame, size: int = SIZE, with_ids: bool = False) -> DataFrame:
    """One row per piece of each document; with_ids adds the piece's ids."""
    schema = PIECES + (", ids binary" if with_ids else "")

    def laid(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sequence, offset = TaskContext.get().partitionId() << 40, 0
        for batch in batches:
            out: list[list] = [[] for _ in range(8 if with_ids else 7)]
            for doc_id, n, packed in zip(batch["doc_id"].to_pylist(), batch["n_tokens"].to_pylist(), batch["ids"].to_pylist(), strict=True):
                ids, start = np.frombuffer(packed, dtype=f"<u{len(packed) // n}").astype("<u4").tobytes(), 0
                while start < n:
                    length = min(n - start, size - offset)
                    piece = ids[4 * start : 4 * (start + length)]
                    for column, value in zip(out, (doc_id, start, length, zlib.crc32(piece), n, sequence, offset, piece), strict=False):
                        column.append(value)
                    start, offset = start + length, offset + length
                    if offset == size:
                        sequence, offset = sequence + 1, 0
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out[:7]] + [pa.array(c, pa.binary()) for c in out[7:]], schema=pa.schema([(f.split()[0], pa.int64() if f.split()[1] == "long" else pa.binary()) for f in schema.split(", ")]))

    total = tokens.agg(F.sum("n_tokens")).collect()[0][0] or 0
    parts = max(1, -(-total // PARTITION_TOKENS))
    return tokens.repartitionByRange(parts, "place", "doc_id").sortWithinPartitions("place", "doc_id").select("doc_id", "n_tokens", "ids").mapInArrow(tidy(laid), schema)


def pack(docs: DataFrame, paths: tuple[str, str] | None = None, size: int = SIZE, with_ids: bool = False) -> DataFrame:
    """Pieces of all rows of docs (doc_id, text), laid along the curve."""
    return lay_out(stored(tokenize(docs, paths or default_tokenizer()), "tokens"), size, with_ids)


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
