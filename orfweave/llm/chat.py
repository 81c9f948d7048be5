"""Chat formatting: transcripts to canonical turns by a hidden Markov model.

Each line of a transcript is in one of six states (a role, and whether the line begins a turn). A line shows a speaker
marker or none, whether it is blank or follows a blank line, how it ends, and its length class; Viterbi finds the most
likely states, and lines of one turn are rendered with the role's canonical marker. Markers are read in several styles
(`User:`, `**Assistant**:`, `### Human:`, `<|system|>`), and a missing or unknown one is filled in by the model.

A conversation of any length is one transcript. Rows are range-sorted by (conv_id, turn, role, text) and cut into chunks of
at most `CHUNK` turns, so no task holds a whole conversation. Each chunk of a long conversation is reduced to the best scores
from each state before it to each state at its end (36 numbers); a Viterbi pass over these gives the states at the borders,
and each chunk is then decoded between its borders. That is the path of the whole transcript, wherever it is cut.

The model is trained on the first `TRAIN_TURNS` turns of at most `TRAIN_CONVERSATIONS` labelled conversations (the smallest
hashed ids); only counts leave the tasks. Defined results: null texts are empty lines, null or unknown roles have no marker
and count as user; turns without a number come last, turns of equal number are ordered by role and text and equal rows are
each a turn; rows without a conv_id are one conversation; an empty table gives no rows; other columns are ignored. A chunk
is also cut at `CHUNK_CHARS` characters, so a task holds that much or one turn. Per conversation, a task holds 36 numbers for
each chunk.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored, table

ROLES = ("system", "user", "assistant")
#: Speaker names by role, in lower case.
NAMES = {"system": "system", "instructions": "system", "user": "user", "human": "user", "customer": "user", "q": "user", "assistant": "assistant", "ai": "assistant", "bot": "assistant", "a": "assistant"}
MARKER = re.compile(r"^\s*(?:<\|([A-Za-z]+)\|>\s*|(?:\#{1,4} |\*\*)?([A-Za-z]+)(?:\*\*)?:(?:\*\*)?(?:\s+|$))")
#: How `transcript` writes markers; a style is chosen by conversation.
STYLES = ({"system": "System:", "user": "User:", "assistant": "Assistant:"}, {"system": "### System:", "user": "### Human:", "assistant": "### AI:"}, {"system": "**Instructions**:", "user": "**Customer**:", "assistant": "**Bot**:"}, {"system": "<|system|>", "user": "<|user|>", "assistant": "<|assistant|>"})
TRAIN_CONVERSATIONS, TRAIN_TURNS, CHUNK, CHUNK_CHARS = 1000, 40, 512, 1 << 20
#: Of turns that are not first, one in this many loses its marker in a made transcript.
LOSE = 5
STATES = 2 * len(ROLES)
FEATURES = (5, 3, 4, 4)


def features(lines: list[str]) -> np.ndarray:
    """For each line: its marker (none, a role, an unknown name), place by blank lines, ending, and length class."""
    out = np.zeros((len(lines), len(FEATURES)), np.int64)
    after_blank = True
    for i, line in enumerate(lines):
        m = MARKER.match(line)
        if m:
            role = NAMES.get((m[1] or m[2]).lower())
            out[i, 0] = 4 if role is None else 1 + ROLES.index(role)
        bare = line.strip()
        out[i, 1] = 2 if not bare else int(after_blank)
        out[i, 2] = 0 if not bare else 1 if bare[-1] == "?" else 2 if bare[-1] in ".!" else 3
        out[i, 3] = 0 if len(bare) < 20 else 1 if len(bare) < 80 else 2 if len(bare) < 250 else 3
        after_blank = not bare
    return out


def _tables() -> list[np.ndarray]:
    """Zeros for the counts: first states, steps, and one table per feature."""
    return [np.zeros(STATES), np.zeros((STATES, STATES)), *(np.zeros((STATES, n)) for n in FEATURES)]


def counts(labelled: Iterator[tuple[list[str], list[int]]]) -> np.ndarray:
    """Counts over (lines, states) of transcripts, as one row of numbers; a state is 2 * role + (1 if the line begins a
    turn), or -1 where it isn't known."""
    first, step, *emit = tables = _tables()
    for lines, states in labelled:
        seen = features(lines)
        if states and states[0] >= 0:
            first[states[0]] += 1
        for a, b in zip(states[:-1], states[1:], strict=True):
            if a >= 0 and b >= 0:
                step[a, b] += 1
        for s, row in zip(states, seen, strict=True):
            if s >= 0:
                for e, value in zip(emit, row, strict=True):
                    e[s, value] += 1
    return np.concatenate([t.ravel() for t in tables])


class Hmm:
    """Log probabilities: first states, steps, and one table per feature."""

    def __init__(self, counted: np.ndarray, smooth: float = 0.1) -> None:
        """From the sum of what `counts` gives, and priors."""
        tables, at = _tables(), 0
        for t in tables:
            t += np.asarray(counted[at : at + t.size]).reshape(t.shape)
            at += t.size
        first, step, *emit = tables
        first += smooth
        step += smooth
        # Endings and lengths say little, so they are smoothed more than markers and blank lines.
        for e, x in zip(emit, (smooth, smooth, 2.0, 2.0), strict=True):
            e += x
        for role in range(len(ROLES)):
            # A marker names its own role before any transcript is seen, so a role that is rare in training is read, too.
            emit[0][2 * role + 1, 1 + role] += 20
            emit[0][2 * role + 1, 0] += 2
            emit[0][2 * role] = [20, 1e-4, 1e-4, 1e-4, smooth] + emit[0][2 * role] * 1e-9
            emit[1][2 * role + 1, 0] += 5
            step[2 * role : 2 * role + 2, 1::2] += 2
            # A turn's other lines keep its role.
            for other in range(len(ROLES)):
                if other != role:
                    step[2 * role : 2 * role + 2, 2 * other] = 1e-9
        # Every text begins with the first line of a turn.
        first[::2] = 1e-9
        log = lambda x: np.log(x / x.sum(-1, keepdims=True))
        self.first, self.step, self.emit = log(first), log(step), [log(e) for e in emit]

    def shown(self, lines: list[str]) -> np.ndarray:
        seen = features(lines)
        return sum(e[:, seen[:, f]].T for f, e in enumerate(self.emit))

    def decode(self, lines: list[str], before: int = -1, after: int = -1) -> list[int]:
        """The most likely states, of equal ones the smaller. before: the state of the line before lines, if there is one;
        after: the state that the last line has, if it is known."""
        if not lines:
            return []
        shown = self.shown(lines)
        score, back = (self.first if before < 0 else self.step[before]) + shown[0], np.zeros((len(lines), STATES), np.int64)
        for i in range(1, len(lines)):
            total = score[:, None] + self.step
            back[i] = total.argmax(0)
            score = total[back[i], np.arange(STATES)] + shown[i]
        out = [int(score.argmax()) if after < 0 else after]
        for i in range(len(lines) - 1, 0, -1):
            out.append(int(back[i, out[-1]]))
        return out[::-1]

    def across(self, lines: list[str], first: bool) -> np.ndarray:
        """Best scores from each state before lines (rows; all equal if lines are the first) to each state of the last."""
        shown = self.shown(lines)
        score = (np.broadcast_to(self.first, (STATES, STATES)) if first else self.step) + shown[0]
        for i in range(1, len(lines)):
            score = (score[:, :, None] + self.step[None]).max(1) + shown[i]
        return score


def borders(matrices: list[np.ndarray]) -> list[tuple[int, int]]:
    """For each chunk of a transcript, from what `across` gives: the states of the line before it and of its last line."""
    score, back = matrices[0][0], []
    for m in matrices[1:]:
        total = score[:, None] + m
        back.append(total.argmax(0))
        score = total.max(0)
    ends = [int(score.argmax())]
    for b in reversed(back):
        ends.append(int(b[ends[-1]]))
    ends = ends[::-1]
    return list(zip([-1, *ends[:-1]], ends, strict=True))


def body(line: str) -> str:
    """A turn's first line without its marker, if that names a known speaker."""
    m = MARKER.match(line)
    return line[m.end() :] if m and (m[1] or m[2]).lower() in NAMES else line


def parse(model: Hmm, text: str) -> list[tuple[str, str]]:
    """(role, text) of the turns of a transcript, markers taken off and blank lines at a turn's ends dropped."""
    lines = text.split("\n") if text else []
    turns: list[tuple[str, list[str]]] = []
    for line, state in zip(lines, model.decode(lines), strict=True):
        if state % 2 or not turns:
            turns.append((ROLES[state // 2], [body(line)]))
        else:
            turns[-1][1].append(line)
    return [(role, "\n".join(part).strip("\n")) for role, part in turns]


def render(turns: list[tuple[str, str]]) -> str:
    return "".join(f"<|{role}|>\n{text}\n<|end|>\n" for role, text in turns)


def rendered(lines: list[str], states: list[int], first: bool, last: bool) -> str:
    """The canonical text of a part of a transcript; texts of all parts, in order, make up that of the whole. The blank line
    before a turn is dropped."""
    out = []
    for i, (line, state) in enumerate(zip(lines, states, strict=True)):
        if state % 2 or (first and not i):
            out.append(("" if first and not i else "<|end|>\n") + f"<|{ROLES[state // 2]}|>\n{body(line)}\n")
        elif line.strip() or i + 1 == len(lines) or not states[i + 1] % 2:
            out.append(line + "\n")
    return "".join(out) + "<|end|>\n" * last


def transcript(key: int, turns: list[tuple], lose: int = LOSE, first: bool = True) -> tuple[list[str], list[int]]:
    """Lines and true states of the transcript of turns (number, role, text) as one would find it: one style of markers,
    some of them lost. first: whether these are the conversation's first turns; else a blank line goes before them."""
    pick = lambda *x: int.from_bytes(hashlib.blake2b(repr(x).encode(), digest_size=4).digest(), "little")
    style = STYLES[pick(key) % len(STYLES)]
    lines: list[str] = []
    states: list[int] = []
    for n, (number, role, text) in enumerate(turns):
        part = (text or "").split("\n")
        place = ROLES.index(role) if role in ROLES else 1
        begins = first and not n
        if role in ROLES and (begins or not (lose and pick(key, number) % lose == 0)):
            part[0] = f"{style[role]} {part[0]}"
        if not begins:
            lines.append("")
            states.append(states[-1] & ~1 if states else -1)
        lines += part
        states += [2 * place + 1] + [2 * place] * (len(part) - 1)
    return lines, states


CHUNKS = "conv_id long, chunk long, turns array<struct<turn:long,role:string,text:string>>"


def chunks(conversations: DataFrame, limit: int = CHUNK, parts: int | None = None) -> DataFrame:
    """CHUNKS rows, stored: consecutive turns of one conversation, in order of chunk. A conversation of very many turns is
    dealt over partitions by the range sort; partitions are streamed."""
    rows = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    order = [F.col("conv_id"), F.col("turn").asc_nulls_last(), F.col("role"), F.col("text")]
    parts = parts or int(conversations.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    kinds = [pa.int64(), pa.int64(), pa.list_(pa.struct([("turn", pa.int64()), ("role", pa.string()), ("text", pa.string())]))]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, held, size, conv = TaskContext.get().partitionId() << 32, [], 0, None

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip((conv, chunk, held), kinds, strict=True)], ["conv_id", "chunk", "turns"])

        for batch in batches:
            for r in batch.to_pylist():
                if held and (r["conv_id"] != conv or len(held) >= limit or size > CHUNK_CHARS):
                    yield row()
                    chunk, held, size = chunk + 1, [], 0
                conv = r.pop("conv_id")
                size += len(r["text"] or "")
                held.append(r)
        if held:
            yield row()

    return stored(rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(cut, CHUNKS), "chunks")


def _turns(r: dict) -> list[tuple]:
    return [(t["turn"], t["role"], t["text"]) for t in r["turns"]]


def fit(cut: DataFrame) -> Hmm:
    """The model of a bounded sample of the conversations in `cut` (rows of `chunks`); tasks send counts alone."""
    firsts = cut.groupBy("conv_id").agg(F.min("chunk").alias("first")).orderBy(F.xxhash64("conv_id"), "conv_id").limit(TRAIN_CONVERSATIONS)
    some = cut.join(F.broadcast(firsts.select(F.col("first").alias("chunk"))), "chunk", "left_semi")

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(sum(t.size for t in _tables()))
        for batch in batches:
            total += counts(transcript(r["conv_id"], _turns(r)[:TRAIN_TURNS]) for r in batch.to_pylist())
        yield pa.RecordBatch.from_arrays([pa.array([total.tolist()])], ["c"])

    found = some.mapInArrow(counted, "c array<double>").select(F.posexplode("c").alias("i", "n")).groupBy("i").agg(F.sum("n").alias("n")).collect()
    total = np.zeros(sum(t.size for t in _tables()))
    for r in found:
        total[r["i"]] = r["n"]
    return Hmm(total)


RESULT = (
    "conv_id long, chunk long, n_turns long, n_found long, n_right long, n_bare long, n_bare_right long, n_bare_alternate long, line_crc long, rendered string"
)


def parsed(cut: DataFrame, model: Hmm) -> DataFrame:
    """For each chunk: the transcript made of it, parsed as a part of its conversation's: figures and the canonical text.

    Texts of a conversation's chunks, in order, make up its canonical text, and figures add up. n_bare: turns without a
    marker; n_bare_right: those whose role the model finds; n_bare_alternate: those that a rule which just alternates user
    and assistant gets right. line_crc: the sum of checksums of (line number, state, line).
    """
    long = cut.groupBy("conv_id").agg(F.count("*").alias("k"), F.min("chunk").alias("first")).where("k > 1")
    wide = stored(cut.alias("c").join(long.alias("l"), F.col("c.conv_id").eqNullSafe(F.col("l.conv_id"))).select("c.*", "l.first"), "long")

    def reduced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], []]
            for r in batch.to_pylist():
                begins = r["chunk"] == r["first"]
                lines, _ = transcript(r["conv_id"], _turns(r), first=begins)
                for column, value in zip(out, (r["conv_id"], r["chunk"], len(lines), model.across(lines, begins).ravel().tolist()), strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int64()), pa.array(out[3], pa.list_(pa.float64()))], ["conv_id", "chunk", "lines", "m"])

    def linked(t: pa.Table) -> pa.Table:
        t = t.sort_by("chunk")
        ends = borders([np.array(m).reshape(STATES, STATES) for m in t["m"].to_pylist()])
        lines = np.concatenate([[0], np.cumsum(t["lines"].to_numpy())[:-1]])
        last = [False] * (len(ends) - 1) + [True]
        return pa.table({"chunk": t["chunk"], "before": pa.array([a for a, _ in ends], pa.int32()), "after": pa.array([b for _, b in ends], pa.int32()), "line": pa.array(lines, pa.int64()), "last": pa.array(last)})

    border = wide.mapInArrow(reduced, "conv_id long, chunk long, lines long, m array<double>").groupBy("conv_id").applyInArrow(linked, "chunk long, before int, after int, line long, last boolean")
    names = [f.split()[0] for f in RESULT.split(", ")]

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in names]
            for r in batch.to_pylist():
                alone = r["before"] is None
                before, after, line, last = (-1, -1, 0, True) if alone else (r["before"], r["after"], r["line"], r["last"])
                first = before < 0
                lines, states = transcript(r["conv_id"], _turns(r), first=first)
                got = model.decode(lines, before, after)
                starts = [i for i, s in enumerate(states) if s % 2 and s >= 0]
                bare = [i for i in starts if not MARKER.match(lines[i])]
                role = lambda i: (got[i - 1] if i else before) // 2  # noqa: B023, E731
                other = [2 * (1 if role(i) == 2 else 2) + 1 if (i or not first) else 3 for i in bare]
                crc = sum(zlib.crc32(f"{line + i}:{s}:{x}".encode("utf-8", "surrogatepass")) for i, (s, x) in enumerate(zip(got, lines, strict=True)))
                row = (r["conv_id"], r["chunk"], len(r["turns"]), sum(s % 2 for s in got) + (first and not got[0] % 2), sum(got[i] == states[i] for i in starts), len(bare), sum(got[i] == states[i] for i in bare), sum(o == states[i] for o, i in zip(other, bare, strict=True)), crc, rendered(lines, got, first, last))
                for column, value in zip(out, row, strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in out[:-1]), pa.array(out[-1], pa.string())], names)

    return cut.join(border, "chunk", "left").mapInArrow(made, RESULT)


def op4_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per conversation: its turns, those found, how many roles are right, and digests of the canonical text."""
    cut = chunks(table(spark, sf_dir, "conversations"))
    found = parsed(cut, fit(cut)).withColumn("rendered_chars", F.length("rendered").cast("long"))
    sums = ["n_turns", "n_found", "n_right", "n_bare", "n_bare_right", "n_bare_alternate", "rendered_chars", "line_crc"]
    return found.groupBy("conv_id").agg(*(F.sum(c).alias(c) for c in sums))
