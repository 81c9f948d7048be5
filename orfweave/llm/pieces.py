"""SentencePiece encoding and decoding: unigram Viterbi over a double-array trie.

Text gets one white-space marker in front, spaces become markers, and the best-scoring sequence of pieces is found. A
character that no piece covers costs the least score less `UNKNOWN` and is written as its bytes' pieces. Pieces hold
markers only at their start, so the search decomposes exactly at each marker that follows another character, and words
are solved once per batch: the lattice of all new words of about equal length is relaxed together, one trie step at a
time. The model's type is read from its file: a unigram model's log scores are used as they are. Scores of other types are
ranks, no log scores; there, Zipf's law gives the piece of rank r the score -ln(r + 1) - ln(H), H the harmonic sum (scores
are not fitted to the corpus, as tokenizers are never trained). Among equal scores the piece that starts first wins.

Defined results: null and empty texts have no pieces; a marker character in a text decodes as a space; long words are
solved by themselves. Nothing is shuffled; a worker holds one batch and a bounded table of words.
"""

from __future__ import annotations

import functools
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

MARK = "▁"
UNKNOWN = 10.0
CACHE = 200_000
#: Words above this many bytes are solved one by one.
LONG = 96
_RUNS = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")


class Trie:
    """Double array: node s has child t = base[s] + byte + 1 where check[t] = s; value[t] is the key's number or -1."""

    def __init__(self, keys: dict[bytes, int]) -> None:
        tree: dict = {}
        for key, number in keys.items():
            node = tree
            for b in key:
                node = node.setdefault(b, {})
            node[-1] = number
        size = 1 << 10
        base, check, value = [0] * size, [-1] * size, [-1] * size
        check[0], first, later, queue = 0, 257, 257, [(0, tree)]
        for state, node in queue:
            codes = sorted(b + 1 for b in node if b >= 0)
            if -1 in node:
                value[state] = node[-1]
            if not codes:
                continue
            # Nodes of one child fill the first gap; searches for several pass over regions that are nearly full.
            began = at = max((first if len(codes) == 1 else max(first, later)) - codes[0], 0)
            while True:
                need = at + codes[-1] + 1
                if need > size:
                    grow = max(size, need - size + 1)
                    base += [0] * grow
                    check += [-1] * grow
                    value += [-1] * grow
                    size += grow
                if all(check[at + c] < 0 for c in codes):
                    break
                at += 1
            base[state] = at
            if at - began > 32:
                later = at
            for c in codes:
                check[at + c] = state
                queue.append((at + c, node[c - 1]))
            while first < size and check[first] >= 0:
                first += 1
        # A margin of 257 free slots: a step from any node stays inside the arrays.
        pad = [0] * 257
        self.base = np.array(base + pad, np.int64)
        self.check = np.array(check + [-1] * 257, np.int64)
        self.value = np.array(value + [-1] * 257, np.int64)


class Model:
    """Pieces with log scores, their trie, and byte pieces."""

    def __init__(self, pieces: list[tuple[str, float]], bytes_of: dict[int, int], unknown_id: int = 0) -> None:
        """pieces: text and log score by id, empty text for ids that text never becomes; bytes_of: byte value to id."""
        self.surface = [p.encode() for p, _ in pieces]
        self.scores = np.array([s for _, s in pieces])
        keys = {p: i for i, p in enumerate(self.surface) if p}
        self.trie = Trie(keys)
        self.longest = max(map(len, keys), default=1)
        self.unknown = min((self.scores[i] for i in keys.values()), default=0.0) - UNKNOWN
        self.bytes_of, self.unknown_id = bytes_of, unknown_id
        self.value_of = {i: bytes([b]) for b, i in bytes_of.items()}
        mark = MARK.encode()
        self.by_word = not any(mark in k.lstrip() and mark in _after_marks(k) for k in keys)
        self.young: dict[str, tuple[int, ...]] = {}
        self.old: dict[str, tuple[int, ...]] = {}

    def fallback(self, char: bytes) -> tuple[int, ...]:
        return tuple(self.bytes_of[b] for b in char) if self.bytes_of else (self.unknown_id,)

    def segments(self, text: str) -> list[str]:
        if not text:
            return []
        if not self.by_word:
            return [MARK + text.replace(" ", MARK)]
        if "  " in text or MARK in text or text[0] == " " or text[-1] == " ":
            return _RUNS.findall(MARK + text.replace(" ", MARK))
        return [MARK + w for w in text.split(" ")]

    def solve(self, words: list[str]) -> list[tuple[int, ...]]:
        """The ids of each word."""
        out: list[tuple[int, ...]] = [()] * len(words)
        data = [w.encode("utf-8", "surrogatepass") for w in words]
        order = sorted(range(len(words)), key=lambda i: len(data[i]))
        at = 0
        while at < len(order):
            longest = max(16, int(len(data[order[at]]) * 1.25))
            end = at + 1
            if len(data[order[at]]) <= LONG:
                while end < len(order) and len(data[order[end]]) <= longest and end - at < 20_000:
                    end += 1
            group = order[at:end]
            for i, ids in zip(group, self._relax([data[i] for i in group]), strict=True):
                out[i] = ids
            at = end
        return out

    def _relax(self, data: list[bytes]) -> Iterator[tuple[int, ...]]:
        if len(data) == 1 and len(data[0]) > LONG:
            yield self._one(data[0])
            return
        size = np.array([len(d) for d in data])
        width = int(size.max())
        cells = np.frombuffer(b"".join(d.ljust(width, b"\0") for d in data), np.uint8).reshape(len(data), width).astype(np.int64)
        base, check, value, scores = self.trie.base, self.trie.check, self.trie.value, self.scores
        best = np.full((width + 1, len(data)), -np.inf)
        best[0] = 0
        back = np.zeros((width + 1, len(data)), np.int64)
        piece = np.full((width + 1, len(data)), -1, np.int64)
        for i in range(width):
            rows = np.flatnonzero((size > i) & (best[i] > -np.inf))
            if not len(rows):
                continue
            start = rows
            lead = cells[rows, i]
            step = 1 + (lead >= 0xC0) + (lead >= 0xE0) + (lead >= 0xF0)
            alone = np.zeros(len(data), bool)
            char = np.zeros(len(data), np.int64)
            char[rows] = step
            node = np.zeros(len(rows), np.int64)
            for j in range(i, min(width, i + self.longest)):
                node_next = base[node] + cells[rows, j] + 1
                fine = (check[node_next] == node) & (size[rows] > j)
                rows, node = rows[fine], node_next[fine]
                if not len(rows):
                    break
                number = value[node]
                hit = number >= 0
                if hit.any():
                    who, what = rows[hit], number[hit]
                    alone[who[char[who] == j + 1 - i]] = True
                    total = best[i, who] + scores[what]
                    better = total > best[j + 1, who]
                    who, what = who[better], what[better]
                    best[j + 1, who], back[j + 1, who], piece[j + 1, who] = total[better], i, what
            who = start[~alone[start]]
            if len(who):
                end = np.minimum(i + char[who], size[who])
                total = best[i, who] + self.unknown
                better = total > best[end, who]
                who, end = who[better], end[better]
                best[end, who], back[end, who], piece[end, who] = total[better], i, -1
        back_rows, piece_rows = back.T.tolist(), piece.T.tolist()
        for d, b, p in zip(data, back_rows, piece_rows, strict=True):
            yield self._walk(d, b, p)

    def _walk(self, data: bytes, back: list[int], piece: list[int]) -> tuple[int, ...]:
        ids: list[int] = []
        end = len(data)
        while end:
            start = back[end]
            ids[:0] = [piece[end]] if piece[end] >= 0 else self.fallback(data[start:end])
            end = start
        return tuple(ids)

    def _one(self, data: bytes) -> tuple[int, ...]:
        """One long word, a byte at a time."""
        base, check, value = self.lists
        scores = self.scores.tolist()
        best, back, piece = [-np.inf] * (len(data) + 1), [0] * (len(data) + 1), [-1] * (len(data) + 1)
        best[0] = 0.0
        for i, lead in enumerate(data):
            if best[i] == -np.inf:
                continue
            char, alone, node = 1 + (lead >= 0xC0) + (lead >= 0xE0) + (lead >= 0xF0), False, 0
            for j in range(i, min(len(data), i + self.longest)):
                after = base[node] + data[j] + 1
                if check[after] != node:
                    break
                node = after
                if value[node] >= 0:
                    alone |= j + 1 - i == char
                    total = best[i] + scores[value[node]]
                    if total > best[j + 1]:
                        best[j + 1], back[j + 1], piece[j + 1] = total, i, value[node]
            end = min(i + char, len(data))
            if not alone and best[i] + self.unknown > best[end]:
                best[end], back[end], piece[end] = best[i] + self.unknown, i, -1
        ids: list[int] = []
        end = len(data)
        while end:
            start = back[end]
            ids.extend(reversed((piece[end],) if piece[end] >= 0 else self.fallback(data[start:end])))
            end = start
        return tuple(reversed(ids))

    @functools.cached_property
    def lists(self) -> tuple[list[int], list[int], list[int]]:
        return self.trie.base.tolist(), self.trie.check.tolist(), self.trie.value.tolist()

    def encode_batch(self, texts: list[str]) -> list[list[int]]:
        parts = [self.segments(t) for t in texts]
        new = {w for p in parts for w in p if w not in self.young}
        local: dict[str, tuple[int, ...]] = {}
        fresh = []
        for w in new:
            if (ids := self.old.get(w)) is not None:
                local[w] = ids
            else:
                fresh.append(w)
        local.update(zip(fresh, self.solve(fresh), strict=True))
        if len(self.young) > CACHE:
            self.young, self.old = {}, self.young
        young = self.young
        out = []
        for p in parts:
            ids: list[int] = []
            for w in p:
                ids += young.get(w) or local.get(w) or self.old[w]
            out.append(ids)
        young.update((w, x) for w, x in local.items() if len(w) <= 64)
        return out

    def decode(self, ids: list[int]) -> str:
        surface, value_of = self.surface, self.value_of
        text = b"".join(surface[i] or value_of.get(i, b"") for i in ids).decode("utf-8", "replace").replace(MARK, " ")
        return text[1:] if text.startswith(" ") else text


def _after_marks(key: bytes) -> bytes:
    mark = MARK.encode()
    while key.startswith(mark):
        key = key[len(mark) :]
    return key


def _fields(data: bytes) -> Iterator[tuple[int, bytes | int]]:
    """(number, value) of the fields of a protocol buffer message: whole numbers, and bytes of all other kinds."""
    at = 0

    def number() -> int:
        nonlocal at
        out = shift = 0
        while True:
            byte = data[at]
            at += 1
            out |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return out

    while at < len(data):
        key = number()
        if key & 7 == 0:
            yield key >> 3, number()
        else:
            size = {1: 8, 5: 4}.get(key & 7) or number()
            yield key >> 3, data[at : at + size]
            at += size


def model_type(data: bytes) -> int:
    """A model file's own type: 1 (unigram, also where it says nothing), 2 (merges), 3 (words), 4 (characters)."""
    for number, trainer in _fields(data):
        if number == 2:
            return next((value for field, value in _fields(trainer) if field == 3), 1)
    return 1


@functools.lru_cache(maxsize=2)
def load(path: str) -> Model:
    """A model of a SentencePiece file. A unigram model's scores are log scores and are taken as they are; those of other
    types are ranks, for which Zipf's law stands in."""
    import sentencepiece

    with open(path, "rb") as f:
        data = f.read()
    p = sentencepiece.SentencePieceProcessor(model_proto=data)
    n = p.get_piece_size()
    bytes_of = {int(p.id_to_piece(i)[3:5], 16): i for i in range(n) if p.is_byte(i)}
    plain = [i for i in range(n) if not (p.is_byte(i) or p.is_control(i) or p.is_unknown(i) or p.is_unused(i))]
    scores = {i: p.get_score(i) for i in plain}
    if model_type(data) != 1:
        harmonic = np.log(np.sum(1 / np.arange(1, len(plain) + 1)))
        scores = {i: float(-np.log(r + 1) - harmonic) for r, i in enumerate(plain)}
    return Model([(p.id_to_piece(i) if i in scores else "", scores.get(i, 0.0)) for i in range(n)], bytes_of, p.unk_id())


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def encode(docs: DataFrame, path: str) -> DataFrame:
    """docs (doc_id, text) with ids array<int>, decoded string."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(path)
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                ids = model.encode_batch([t or "" for t in part["text"].to_pylist()])
                yield pa.RecordBatch.from_arrays([part["doc_id"], part["text"], pa.array(ids, pa.list_(pa.int32())), pa.array([model.decode(x) for x in ids])], ["doc_id", "text", "ids", "decoded"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(made, "doc_id long, text string, ids array<int>, decoded string")


def encode_digest(docs: DataFrame, path: str) -> DataFrame:
    """What `encode` gives, as figures per document: counts, a checksum of the ids, and whether decoding gives the text."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(path)
        is_byte = np.zeros(len(model.surface), bool)
        is_byte[list(model.value_of)] = True
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                texts = [t or "" for t in part["text"].to_pylist()]
                ids = model.encode_batch(texts)
                same = [model.decode(x) == t.replace(MARK, " ") for x, t in zip(ids, texts, strict=True)]
                packed = [np.array(x, dtype="<u4") for x in ids]
                yield pa.RecordBatch.from_arrays([part["doc_id"], pa.array([len(x) for x in ids], pa.int64()), pa.array([int(is_byte[x].sum()) for x in packed], pa.int64()), pa.array([zlib.crc32(x.tobytes()) for x in packed], pa.int64()), pa.array(same)], ["doc_id", "n_pieces", "n_byte_pieces", "ids_crc32", "round_trip"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(made, "doc_id long, n_pieces long, n_byte_pieces long, ids_crc32 long, round_trip boolean")


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_digest(table(spark, sf_dir, "documents"), default_model())
