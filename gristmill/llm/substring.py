"""Removal of repeated word windows through difference-cover anchors."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import OTHER_BASE, WordHashes, batch_of, exchange_width, released, mixed, small_batches, window_hashes, words_of
from .exchange import PACKED, Outbox, doc_bucket, exchanged, repeated_places, sent, unpacked


def difference_cover(period: int) -> list[int]:
    """The first smallest set whose differences meet every residue modulo ``period``, found by depth-first search."""
    for size in range(2, period + 1):

        def search(chosen: list[int], size: int = size) -> list[int] | None:
            if len(chosen) == size:
                return chosen if len({(a - b) % period for a in chosen for b in chosen}) == period else None
            for x in range(chosen[-1] + 1, period):
                if found := search([*chosen, x]):
                    return found
            return None

        if found := search([0]):
            return found
    return [0]


MESSAGE = "bucket int, keys binary, docs binary, places binary, checks binary, texts binary"
_TEXTS = pa.schema([("bucket", pa.int32()), ("keys", pa.binary()), ("docs", pa.binary()), ("places", pa.binary()), ("checks", pa.binary()), ("texts", pa.binary())])


def packed_texts(docs: DataFrame, width: int, flush_bytes: int = 16_000_000) -> DataFrame:
    """Rows (key, then the columns to carry, text first) in compressed Arrow blocks: one for each receiving bucket and stretch of input."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0

        def out() -> pa.RecordBatch:
            rows, own = [], pa.Table.from_batches(held).combine_chunks()
            held.clear()
            buckets = doc_bucket(own.column(0).to_numpy(), width)
            for bucket in np.unique(buckets).tolist():
                block, sink = own.take(pa.array(np.flatnonzero(buckets == bucket))), pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, block.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 1))) as to:
                    to.write_table(block)
                rows.append((bucket, None, None, None, None, sink.getvalue().to_pybytes()))
            return batch_of(_TEXTS, [*map(list, zip(*rows))])

        for b in batches:
            step = max(1, int(b.num_rows * min(1.0, flush_bytes / max(1, b.nbytes))))
            for s in range(0, b.num_rows, step):
                held.append(part := b.slice(s, step))
                size += part.nbytes
                if size >= flush_bytes:
                    yield out()
                    size = 0
        if held:
            yield out()

    return docs.mapInArrow(released(run), MESSAGE)


def delivered(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    """Record batches of the rows that came to this task, each with the places of every row, in an order that doesn't depend on arrival."""
    answers, blocks = [], []
    for b in batches:
        for _, _, d, p, _, t in zip(*(c.to_pylist() for c in b.columns)):
            answers.append((b"", d, p, b"")) if t is None else blocks.append(t)
    _, docs, places, _ = unpacked(answers)
    del answers
    order = np.lexsort((places, docs))
    docs, places = docs[order], places[order]
    for block in sorted(blocks):
        for b in pa.ipc.open_stream(block):
            keys = b.column(0).to_numpy()
            first, last = np.searchsorted(docs, keys, "left").tolist(), np.searchsorted(docs, keys, "right").tolist()
            yield b, [places[s:e] for s, e in zip(first, last)]


def word_hashes(words: list[bytes], table: WordHashes) -> np.ndarray:
    return np.fromiter(map(table.__getitem__, words), np.uint64, len(words))


def row_key(docs: DataFrame, bits: int = 63) -> Column:
    """A non-negative number for each row, from ``bits`` of a hash of doc_id and text; equal rows share one.

    Rows that differ share a first hash in about n * n / 2**64 cases of n rows; those few hashes reach the driver, and their
    rows take a further hash, until no key is shared by rows whose other hashes differ.
    """
    hashes = [F.xxhash64(F.lit(k), "doc_id", "text").bitwiseAND((1 << 63) - 1) for k in range(2)]
    key, other = F.shiftright(hashes[0], 63 - bits), hashes[1]
    taken: list[int] = []
    while True:
        rows = docs.select(key.alias("key"), other.alias("other"))
        clash = rows.groupBy("key").agg(F.min("other").alias("low"), F.max("other").alias("high")).where("low <> high").select("key").collect()
        if not clash:
            return key
        taken += [r.key for r in clash]
        key = F.when(F.shiftright(hashes[0], 63 - bits).isin(taken), F.xxhash64(F.lit(3 + len(taken)), "doc_id", "text").bitwiseAND((1 << 63) - 1)).otherwise(F.shiftright(hashes[0], 63 - bits))


REMOVED = "doc_id long, n_words long, n_removed long, kept_sha256 string"


def repeated_windows_removed(docs: DataFrame, window: int = 35, period: int = 21, rows_too: bool = False, bits: int = 63) -> DataFrame:
    """Remove each word covered by a window of ``window`` words that also starts anywhere else.

    Anchors of ``window - period + 1`` words are hashed at positions that lie, modulo ``period``, in a
    difference cover. Two equal windows share an anchor at one offset below ``period`` at least, so a
    window can be repeated only if an anchor in it is. Those candidates are extended to the whole window
    by their own hash of 128 bits, which decides. Four packed exchanges: anchors by hash, answers with texts by row, windows
    by hash, answers with texts by row. A key that a sender holds twice is answered there, so no
    receiver gets more than a row for each sender and key, whatever the number of copies.

    Null and empty texts and those shorter than the window lose nothing; rows with the same doc_id (or none)
    are judged one by one, and equal rows count as places of their own. With ``rows_too`` the rows of docs come
    back instead, all columns, with the kept words joined by one space as text (texts that lose nothing stay as they are); else
    other columns are not read. Words are compared by two independent hashes of a window, 128 bits together; words
    themselves have 64. Rows are told apart by 128 bits too (see row_key).
    """
    cover = difference_cover(period)
    anchor = window - period + 1
    rest = [c for c in docs.columns if c != "text"]
    key = row_key(docs, bits).alias("_key")
    base = docs.select(key, "text", *rest) if rows_too else docs.select(key, "text", F.col("doc_id").cast("long").alias("doc_id"))
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string())])
    small_batches(docs.sparkSession)
    width = exchange_width(base)

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, box = WordHashes(), Outbox(width)
        lattice = np.zeros(period, bool)
        lattice[cover] = True
        for b in batches:
            for key, t in zip(b.column(0).to_pylist(), b.column(1)):
                words = words_of(t.as_py())
                if len(words) >= window:
                    at = np.flatnonzero(np.resize(lattice, len(words) - anchor + 1))
                    box.add(window_hashes(word_hashes(words, table), anchor)[at], key, at)
                if box.full():
                    yield from sent(box)
        yield from sent(box)

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, box = WordHashes(), Outbox(width)
        for b, found in delivered(batches):
            for key, t, places in zip(b.column(0).to_pylist(), b.column(1), found):
                if not len(places):
                    continue
                words = words_of(t.as_py())
                marks = np.zeros(len(words) + 1, np.int32)
                marks[places + 1] = 1
                total = np.cumsum(marks)
                starts = np.arange(len(words) - window + 1)
                at = starts[total[starts + period] > total[starts]]
                if len(at):
                    hashes = word_hashes(words, table)
                    box.add(window_hashes(hashes, window)[at], key, at, window_hashes(mixed(hashes), window, OTHER_BASE)[at])
                if box.full():
                    yield from sent(box)
        yield from sent(box)

    def removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, found in delivered(batches):
            counts, gone, digests, texts = [], [], [], []
            for t, places in zip(b.column(1), found):
                text = t.as_py()
                words = words_of(text)
                kept = words
                if len(places):
                    edges = np.zeros(len(words) + 1, np.int32)
                    np.add.at(edges, places, 1)
                    np.add.at(edges, places + window, -1)
                    kept = [words[i] for i in np.flatnonzero(np.cumsum(edges[:-1]) == 0).tolist()]
                joined = b" ".join(kept)
                counts.append(len(words))
                gone.append(len(words) - len(kept))
                digests.append(hashlib.sha256(joined).hexdigest())
                texts.append(joined.decode("utf-8", "surrogatepass") if len(kept) < len(words) else text)
            if rows_too:
                yield pa.RecordBatch.from_arrays([pa.array(texts, b.schema.field(1).type), *b.columns[2:]], names=b.schema.names[1:])
            else:
                yield batch_of(schema, [b.column(2), counts, gone, digests])

    def with_texts(answers: DataFrame, rows: DataFrame) -> DataFrame:
        return exchanged(answers.withColumn("texts", F.lit(None).cast("binary")).unionByName(packed_texts(rows, width)), width)

    narrow = base.select("_key", "text")
    found = repeated_places(narrow.mapInArrow(released(anchors), PACKED), width)
    windows = repeated_places(with_texts(found, narrow).mapInArrow(released(candidates), PACKED), width)
    done = with_texts(windows, base)
    return done.mapInArrow(released(removed), base.drop("_key").schema).select(docs.columns) if rows_too else done.mapInArrow(released(removed), REMOVED)
