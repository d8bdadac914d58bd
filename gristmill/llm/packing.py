"""Packing tokenised documents into fixed-length sequences by cutting-stock column generation."""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import LONGEST_KEY, batch_of, released, small_batches, written

#: The pre-tokenisation pattern of the byte-level vocabulary, and Unicode's white space.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
WHITE = "\t-\r \x85\xa0  -     　"
SPECIAL = "<|endoftext|>"


def byte_characters() -> dict[str, int]:
    """The character that stands for each byte in the vocabulary: itself if printable, else the next one from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


class ByteBPE(dict):
    """White-space chunk -> its ids as little-endian uint32; a chunk is cut as the whole text would be.

    Merges, ids and pattern are those of the tokenizer file; new chunks are merged by the faster of the two
    libraries that know this format, and the tests hold the ids against the other. The table is emptied at
    ``most`` entries. A text that holds a special token's string goes whole to the library that knows special tokens.
    """

    def __init__(self, tokenizer_file: str, most: int = 200_000):
        import json
        import re

        import tiktoken

        super().__init__()
        self.most, self.file, self._model = most, tokenizer_file, None
        raw = byte_characters()
        with open(tokenizer_file, encoding="utf-8") as f:
            ranks = {bytes(raw[c] for c in t): i for t, i in json.load(f)["model"]["vocab"].items() if t != SPECIAL}
        self._merge = tiktoken.Encoding("byte-level", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self._chunks = re.compile(f" ?[^{WHITE}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+").findall

    @property
    def model(self):  # noqa: ANN201
        """The tokenizer file in its own library, loaded where a text needs it."""
        if self._model is None:
            from tokenizers import Tokenizer

            self._model = Tokenizer.from_file(self.file)
        return self._model

    def __missing__(self, chunk: str) -> bytes:
        found = array("I", self._merge(chunk)).tobytes()
        if len(chunk) <= LONGEST_KEY:
            if len(self) >= self.most:
                self.clear()
            self[chunk] = found
        return found

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if SPECIAL in text:
            return array("I", self.model.encode(text, add_special_tokens=False).ids).tobytes()
        return b"".join([*map(self.__getitem__, self._chunks(text))])


_TABLES: dict[str, ByteBPE] = {}


def byte_bpe(tokenizer_file: str) -> ByteBPE:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if tokenizer_file not in _TABLES:
        _TABLES[tokenizer_file] = ByteBPE(tokenizer_file)
    return _TABLES[tokenizer_file]


@dataclass
class Plan:
    """Where tails go. slots: rows (length, first rank, copies in the pattern, first sequence, offset) for
    ranks from ``first`` on, ``times`` sequences each; tape: length -> (first rank, first position)."""

    slots: np.ndarray
    times: np.ndarray
    tape: dict[int, tuple[int, int]]
    tape_sequence: int
    tape_tokens: int


def first_basis(lengths: np.ndarray, demand: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """A feasible triangular basis: each pattern takes the longest tails left that still fit, until one length runs out."""
    m, left = len(lengths), demand.astype(float)
    basis, level, have = np.zeros((m, m)), np.zeros(m), left > 0
    for _ in range(m):
        open_ = np.flatnonzero(have)
        if not len(open_):
            break
        pattern, room = np.zeros(m), capacity
        while True:
            i = np.searchsorted(lengths[open_], room, side="right") - 1
            if i < 0:
                break
            k = open_[i]
            n = max(1, min(room // lengths[k], int(left[k])))
            pattern[k] += n
            room -= n * lengths[k]
            open_ = open_[:i]
        used = np.flatnonzero(pattern)
        k = used[(left[used] / pattern[used]).argmin()]
        amount = left[k] / pattern[k]
        basis[:, k], level[k] = pattern, amount
        left[used] = np.maximum(left[used] - amount * pattern[used], 0)
        have[k] = False
    return basis, level


def columns(lengths: np.ndarray, demand: np.ndarray, capacity: int, gap: float, most_rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Basis patterns (one column each) and their levels of the linear program: fewest sequences over all tails.

    Revised simplex. Each round a knapsack dynamic program over the capacity prices a new pattern at the
    dual values; it ends when no pattern is worth more than one sequence, when the dual bound is
    within ``gap`` of the level, or after ``most_rounds``; any basis gives valid patterns, a later one fewer sequences. Rows: at most ``capacity`` - 1, however many documents there are.
    """
    m = len(lengths)
    basis, level = first_basis(lengths, demand, capacity)
    inverse = np.linalg.inv(basis)
    best, pick = np.zeros(capacity + 1), np.zeros(capacity + 1, np.int64)
    reach = np.searchsorted(lengths, np.arange(capacity + 1), side="right")
    for _ in range(most_rounds):
        dual = inverse.sum(axis=0)
        for c in range(1, capacity + 1):
            k = reach[c]
            if k:
                worth = dual[:k] + best[c - lengths[:k]]
                pick[c] = i = worth.argmax()
                best[c] = worth[i]
            if not k or best[c] < best[c - 1]:
                best[c], pick[c] = best[c - 1], -1
        if best[capacity] <= 1 + gap:
            break
        pattern, c = np.zeros(m), capacity
        while c > 0 and reach[c]:
            if pick[c] < 0:
                c -= 1
            else:
                pattern[pick[c]] += 1
                c -= lengths[pick[c]]
        used = np.flatnonzero(pattern)
        step = inverse[:, used] @ pattern[used]
        rows = np.flatnonzero(step > 1e-9)
        ratio = level[rows] / step[rows]
        out = rows[ratio.argmin()]
        amount = level[out] / step[out]
        level = np.maximum(level - amount * step, 0)
        level[out] = amount
        row = inverse[out] / step[out]
        inverse -= np.outer(step, row)
        inverse[out] = row
        basis[:, out] = pattern
    return basis, level


def plan(counts: dict[int, int], capacity: int, gap: float = 0.005, most_rounds: int = 600, most_waste: int = 4) -> Plan:
    """Integer patterns for the histogram of tail lengths, and a tape for what they leave.

    Levels are rounded down; patterns are then taken once more, largest fraction first, while their
    tails last. Patterns that waste over ``most_waste`` ids are not used. Tails left over are laid end
    to end on a tape and cut at every ``capacity`` ids, the last stretch at powers of two, so that
    only the patterns' own waste is padding.
    """
    lengths = np.array(sorted(counts), np.int64)
    left = np.array([counts[int(n)] for n in lengths], np.int64)
    used = np.zeros_like(left)
    slots, times, sequence = [], [], 0

    def take(pattern: np.ndarray, n: int) -> None:
        nonlocal sequence
        offset = 0
        for i in np.flatnonzero(pattern):
            slots.append((int(lengths[i]), int(used[i]), int(pattern[i]), sequence, offset))
            times.append(n)
            used[i] += pattern[i] * n
            left[i] -= pattern[i] * n
            offset += int(pattern[i] * lengths[i])
        sequence += n

    if len(lengths):
        basis, level = columns(lengths, left.astype(float), capacity, gap, most_rounds)
        basis = basis.astype(np.int64).T
        good = [k for k in range(len(level)) if 0 <= capacity - basis[k] @ lengths <= most_waste]
        order = sorted(good, key=lambda k: (-(level[k] % 1), k))
        for k in order:
            if n := min([int(level[k] + 1e-7), *(left[i] // basis[k][i] for i in np.flatnonzero(basis[k]))]):
                take(basis[k], int(n))
        for k in order:
            i = np.flatnonzero(basis[k])
            if (left[i] >= basis[k][i]).all():
                take(basis[k], 1)
    tape, position = {}, 0
    for n, first, count in zip(lengths, used, left):
        tape[int(n)] = (int(first), position)
        position += int(n) * int(count)
    return Plan(np.array(slots, np.int64).reshape(-1, 5), np.array(times, np.int64), tape, sequence, position)


class Placer:
    """The pieces of one tail under a plan."""

    def __init__(self, p: Plan, capacity: int):
        self.plan, self.capacity = p, capacity
        self.by: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        if len(p.slots):
            order = np.lexsort((p.slots[:, 1], p.slots[:, 0]))
            rows = p.slots[order]
            for n in np.unique(rows[:, 0]):
                own = rows[rows[:, 0] == n]
                self.by[int(n)] = (own[:, 1], own)
        # the last stretch of the tape is cut at the powers of two that sum to it
        whole = p.tape_tokens // capacity
        self.cuts = [(whole * capacity, None)]
        rest, at = p.tape_tokens % capacity, whole * capacity
        for bit in reversed(range(capacity.bit_length())):
            if rest >> bit & 1:
                self.cuts.append((at, 1 << bit))
                at += 1 << bit

    def on_tape(self, position: int) -> tuple[int, int, int]:
        """Sequence on the tape, offset in it and room from there, of a position."""
        whole = self.cuts[0][0]
        if position < whole:
            return position // self.capacity, position % self.capacity, self.capacity - position % self.capacity
        for k, (at, size) in enumerate(self.cuts[1:]):
            if position < at + size:
                return whole // self.capacity + k, position - at, at + size - position
        raise IndexError(position)

    def __call__(self, length: int, rank: int) -> list[tuple[int, int, int, int]]:
        """(start in the tail, length, sequence, offset) of each piece of the tail of this length and rank."""
        first, position = self.plan.tape[length]
        if rank < first:
            starts, rows = self.by[length]
            _, begin, copies, sequence, offset = rows[np.searchsorted(starts, rank, side="right") - 1]
            k = rank - int(begin)
            return [(0, length, int(sequence) + k // int(copies), int(offset) + k % int(copies) * length)]
        at, pieces, done = position + (rank - first) * length, [], 0
        while done < length:
            sequence, offset, room = self.on_tape(at + done)
            n = min(room, length - done)
            pieces.append((done, n, self.plan.tape_sequence + sequence, offset))
            done += n
        return pieces


TOKENISED = "doc_id long, part int, doc_tokens long, full_crcs array<long>, full_from long, tail_length int, tail_rank long, tail binary"
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def tokenised(docs: DataFrame, tokenizer_file: str, capacity: int) -> DataFrame:
    """One row for each document: checksums of its whole sequences, and its tail with a rank among the task's tails of that length."""
    schema = pa.schema([("doc_id", pa.int64()), ("part", pa.int32()), ("doc_tokens", pa.int64()), ("full_crcs", pa.list_(pa.int64())), ("full_from", pa.int64()), ("tail_length", pa.int32()), ("tail_rank", pa.int64()), ("tail", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, coder, width = TaskContext.get().partitionId(), byte_bpe(tokenizer_file), 4 * capacity
        ranks, fulls = [0] * capacity, 0
        for b in batches:
            ids = b.column(0).to_pylist()
            rows = []
            for doc, text in zip(ids, b.column(1)):
                data = coder.encode(text.as_py()) + b"\0\0\0\0"
                whole = len(data) // width
                crcs = [zlib.crc32(data[i * width : (i + 1) * width]) for i in range(whole)]
                tail = data[whole * width :]
                n = len(tail) // 4
                rows.append((doc, part, len(data) // 4, crcs, fulls, n, ranks[n], tail))
                ranks[n] += 1
                fulls += whole
            if rows:
                yield batch_of(schema, [*map(list, zip(*rows))])

    return docs.selectExpr("cast(doc_id as bigint) doc_id", "text").mapInArrow(released(run, lambda: byte_bpe(tokenizer_file).clear()), TOKENISED)


def pack(docs: DataFrame, tokenizer_file: str, capacity: int = 1024, gap: float = 0.005, most_rounds: int = 600, most_waste: int = 4) -> DataFrame:
    """Pieces of all documents in sequences of at most ``capacity`` ids; see PIECES for the columns.

    A document's ids (its text's, then id 0; null text: only the 0) fill whole sequences of their own;
    its tail, shorter than ``capacity``, goes by rank within its length to a pattern of the cutting-stock
    solution, or to the tape. Only the histogram of tail lengths (under ``capacity`` rows) reaches the
    driver. Ranks come from counters kept in the task that wrote the row, plus a prefix sum over tasks
    in a table of (task, length), so copies that share a length are spread over their tasks. Rows with
    the same doc_id are packed one by one. The tokenised table is written to the shared folder, so a
    lost executor can't change ranks between the passes. Other columns are not read. No rows: no pieces.
    """
    small_batches(docs.sparkSession)
    held = written(tokenised(docs, tokenizer_file, capacity))
    by_task = held.groupBy("part", "tail_length").agg(F.count("*").alias("n"))
    counts = {r.tail_length: r.n for r in by_task.groupBy("tail_length").agg(F.sum("n").alias("n")).collect() if r.tail_length}
    solution = plan(counts, capacity, gap, most_rounds, most_waste)
    before = Window.partitionBy("tail_length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = by_task.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    schema = pa.schema([(n.split()[0], pa.int64()) for n in PIECES.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = Placer(solution, capacity)
        for b in batches:
            out = []
            for doc, part, tokens, crcs, full, n, rank, tail, base in zip(*(c.to_pylist() for c in b.columns)):
                for i, crc in enumerate(crcs):
                    out.append((doc, i * capacity, capacity, crc, tokens, (part + 1 << 40) + full + i, 0))
                if n:
                    for start, length, sequence, offset in place(n, base + rank):
                        out.append((doc, len(crcs) * capacity + start, length, zlib.crc32(tail[4 * start : 4 * (start + length)]), tokens, sequence, offset))
            if out:
                yield batch_of(schema, [*map(list, zip(*out))])

    names = [c.split()[0] for c in TOKENISED.split(", ")]
    return held.join(bases, ["part", "tail_length"]).select(*names, "base").mapInArrow(released(run), PIECES)
