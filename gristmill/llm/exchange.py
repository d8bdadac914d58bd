"""Packed exchanges: numpy columns of many rows travel as a few binary values, one row for each sender and receiver."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch_of, mixed, released

PACKED = "bucket int, keys binary, docs binary, places binary, checks binary"
PACKED_SCHEMA = pa.schema([("bucket", pa.int32()), ("keys", pa.binary()), ("docs", pa.binary()), ("places", pa.binary()), ("checks", pa.binary())])


def packed(buckets: np.ndarray, *columns: np.ndarray | None) -> Iterator[tuple]:
    """One row for each receiving bucket, the bucket and the bytes of each column (none: empty). The order of the input is kept within a bucket."""
    if not len(buckets):
        return
    order = np.argsort(buckets, kind="stable")
    b, columns = buckets[order], [c if c is None else c[order] for c in columns]
    cuts = np.flatnonzero(np.diff(b)) + 1
    for s, e in zip([0, *cuts], [*cuts, len(b)]):
        yield int(b[s]), *(b"" if c is None else c[s:e].tobytes() for c in columns)


def unpacked(rows: list[tuple[bytes, ...]]) -> list[np.ndarray]:
    """keys, docs, places and checks of packed rows, one behind the other."""
    return [np.frombuffer(b"".join(r[i] for r in rows), t) for i, t in enumerate((np.uint64, np.int64, np.int32, np.uint64))]


class Outbox:
    """Collects (key, doc, place) of one task, doc and place not negative, and sends them by key, or by doc where the answer is known.

    With ``checks`` a key has 64 bits more, and two keys are the same only if all 128 are. A key that the outbox holds twice
    is known to be repeated: all its places are answered at once, and only one unanswered row (doc -1) goes out, so that others
    with the key learn of it. So a key has at most a row for each flush of each task at its receiver, however often it occurs.
    """

    def __init__(self, width: int, most: int = 1_000_000):
        self.width, self.most, self.size, self.held = width, most, 0, []

    def add(self, keys: np.ndarray, doc: int, places: np.ndarray, checks: np.ndarray | None = None) -> None:
        if len(keys):
            self.held.append((keys, doc, places, checks))
            self.size += len(keys)

    def full(self) -> bool:
        return self.size >= self.most

    def flush(self) -> Iterable[tuple]:
        if not self.held:
            return
        keys = np.concatenate([h[0] for h in self.held])
        docs = np.repeat(np.array([h[1] for h in self.held], np.int64), [len(h[0]) for h in self.held])
        places = np.concatenate([h[2] for h in self.held]).astype(np.int32)
        checks = None if self.held[0][3] is None else np.concatenate([h[3] for h in self.held])
        self.held, self.size = [], 0
        order = np.argsort(keys, kind="stable") if checks is None else np.lexsort((checks, keys))
        same = same_as_before(keys, checks, order)
        twice = marked_twice(same)
        markers = order[~same & twice]
        repeated = np.zeros(len(keys), bool)
        repeated[order] = twice
        single = np.flatnonzero(~repeated)
        of = lambda c, at: None if c is None else c[at]
        yield from packed(key_bucket(keys[single], self.width), keys[single], docs[single], places[single], of(checks, single))
        yield from packed(key_bucket(keys[markers], self.width), keys[markers], np.full(len(markers), -1, np.int64), np.zeros(len(markers), np.int32), of(checks, markers))
        # answered: key 0 and the receiver by document
        yield from packed(doc_bucket(docs[repeated], self.width), np.zeros(repeated.sum(), np.uint64), docs[repeated], -1 - places[repeated], None)


def key_bucket(keys: np.ndarray, width: int) -> np.ndarray:
    return ((keys >> np.uint64(20)) % np.uint64(width)).astype(np.int32)


def doc_bucket(docs: np.ndarray, width: int) -> np.ndarray:
    return (mixed(docs.astype(np.uint64)) % np.uint64(width)).astype(np.int32)


def exchanged(rows: DataFrame, width: int) -> DataFrame:
    return rows.repartitionById(width, F.col("bucket"))


def same_as_before(keys: np.ndarray, checks: np.ndarray | None, order: np.ndarray) -> np.ndarray:
    """In this order, whether a key (with its check) equals the one before it."""
    same = np.zeros(len(order), bool)
    s = keys[order]
    same[1:] = s[1:] == s[:-1]
    if checks is not None and len(checks):
        c = checks[order]
        same[1:] &= c[1:] == c[:-1]
    return same


def marked_twice(same: np.ndarray) -> np.ndarray:
    """Those that occur twice or more, from same_as_before()."""
    twice = same.copy()
    twice[:-1] |= same[1:]
    return twice


def repeated_places(sent: DataFrame, width: int, lot: int = 2_000_000) -> DataFrame:
    """Of (key, doc, place) rows sent by an Outbox: places whose key occurs twice or more, by document bucket.

    A receiver holds its rows as they came and sorts them in lots of about ``lot``, equal keys in one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, known = [], []
        for b in batches:
            for _, *row in zip(*(c.to_pylist() for c in b.columns)):
                (known if np.frombuffer(row[2][:4], np.int32)[0] < 0 else asked).append(row)
        keys, docs, places, checks = unpacked(asked)
        del asked
        _, known_docs, known_places, _ = unpacked(known)
        del known
        hits = []
        for at in lots(keys, lot):
            own = None if not len(checks) else checks[at]
            order = np.argsort(keys[at], kind="stable") if own is None else np.lexsort((own, keys[at]))
            hits.append(at[order[marked_twice(same_as_before(keys[at], own, order))]])
        hit = np.concatenate(hits) if hits else np.empty(0, np.int64)
        hit = hit[docs[hit] >= 0]
        docs = np.concatenate([docs[hit], known_docs])
        places = np.concatenate([places[hit], -1 - known_places])
        order = np.lexsort((places, docs))
        docs, places = docs[order], places[order]
        rows = [*packed(doc_bucket(docs, width), None, docs, places, None)]
        if rows:
            yield batch_of(PACKED_SCHEMA, [*map(list, zip(*rows))])

    return exchanged(sent, width).mapInArrow(released(run), PACKED)


def lots(values: np.ndarray, most: int) -> Iterator[np.ndarray]:
    """Places of the values in lots of about ``most``, equal ones in one lot, so that sorting takes little memory."""
    n = -(-len(values) // most)
    if n <= 1:
        yield np.arange(len(values))
        return
    of = mixed(values.astype(np.uint64)) % np.uint64(n)
    for k in range(n):
        yield np.flatnonzero(of == k)


def sent(box: Outbox) -> Iterator[pa.RecordBatch]:
    rows = [*box.flush()]
    if rows:
        yield batch_of(PACKED_SCHEMA, [*map(list, zip(*rows))])
