"""SentencePiece encoding and decoding through a distinct-chunk table."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import LONGEST_KEY, batch_of, released, small_batches

SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])
_RUNS = re.compile(" *[^ ]+| +")


class ChunkTable(dict):
    """Marked chunk (spaces, then a run without any) -> (ids as little-endian uint32, decoded text).

    Valid when no piece of the model has a marker after another character: merges then never cross
    from one chunk to the next. The constructor checks that over the whole vocabulary. The table is
    emptied at ``most`` entries and keeps no key of over LONGEST_KEY characters, so its memory doesn't follow the corpus.
    """

    def __init__(self, model_file: str, most: int = 300_000):
        import sentencepiece

        super().__init__()
        self.most, self.long = most, []
        self.model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        if any(re.search("[^▁]▁", p) for p in pieces):
            raise ValueError("pieces of this model cross whitespace markers")
        anchor = self.model.encode("x")
        if len(anchor) != 1:
            raise ValueError("the model has no piece for the anchor word")
        self.anchor = anchor[0]
        self.plain_from = 1 + max(i for i in range(len(pieces)) if self.model.is_control(i) or self.model.is_unknown(i) or self.model.is_byte(i) or self.model.is_unused(i))
        self.ends = [self.model.bos_id().to_bytes(4, "little"), self.model.eos_id().to_bytes(4, "little")]

    def learn(self, chunks: Iterable[str]) -> None:
        """Segment the chunks that the table doesn't hold, each once."""
        wanted = set(chunks)
        new = [*wanted.difference(self)]
        if len(self) + len(new) > self.most:
            self.clear()
            new = [*wanted]
        for chunk, ids in zip(new, self.model.encode(["x" + c for c in new], num_threads=1)):
            ids = ids[1:]
            # ordinary pieces decode to the characters they were cut from; bytes and unknowns go through the library
            decoded = chunk if min(ids) >= self.plain_from else self.model.decode([self.anchor, *ids])[1:]
            self[chunk] = (np.array(ids, "<u4").tobytes(), decoded)
            if len(chunk) > LONGEST_KEY:
                self.long.append(chunk)

    def chunks(self, text: str) -> list[str]:
        """Chunks of the marked text in order; joined they are the text behind one dummy space."""
        text = " " + text.replace("▁", " ")
        if "  " not in text and text[-1] != " ":
            return [*map(str.__add__, repeat(" "), text[1:].split(" "))]
        return _RUNS.findall(text)

    def encode(self, texts: list[str | None]) -> list[tuple[bytes, str]]:
        """For each text its ids with begin and end, as little-endian uint32, and the decoded text."""
        cut = [self.chunks(t) if t else [] for t in texts]
        self.learn(chain.from_iterable(cut))
        found = []
        for chunks in cut:
            rows = [*map(self.__getitem__, chunks)]
            decoded = "".join([r[1] for r in rows])
            found.append((b"".join([self.ends[0], *[r[0] for r in rows], self.ends[1]]), decoded[1:] if decoded[:1] == " " else decoded))
        for chunk in self.long:  # the table keeps no long key beyond the texts at hand
            self.pop(chunk, None)
        self.long.clear()
        return found


def grouped(texts: Iterable[str | None], chars: int = 500_000) -> Iterator[list[str | None]]:
    """The texts in order, in lists of about so many characters."""
    held, size = [], 0
    for t in texts:
        held.append(t)
        size += len(t or "")
        if size >= chars:
            yield held
            held, size = [], 0
    yield held


_TABLES: dict[str, ChunkTable] = {}


def chunk_table(model_file: str) -> ChunkTable:
    """One model for each worker process; its table is filled anew in each task."""
    if model_file not in _TABLES:
        _TABLES[model_file] = ChunkTable(model_file)
    return _TABLES[model_file]


def encode_decode(docs: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode and decode every whole text; per row the id count and the digests of ids and decoded text.

    Narrow: no shuffle, one pass over two columns. Each distinct chunk is segmented once for each
    worker's table and its ids are joined back by position. Null text counts as empty (two ids, the
    ends). Repeated rows give repeated results; other columns are not read.
    """

    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = chunk_table(model_file)
        for b in batches:
            counts, ids_sha, text_sha = [], [], []
            for texts in grouped(t.as_py() for t in b.column(1)):
                for ids, decoded in held.encode(texts):
                    counts.append(len(ids) // 4)
                    ids_sha.append(hashlib.sha256(ids).hexdigest())
                    text_sha.append(hashlib.sha256(decoded.encode("utf-8", "surrogatepass")).hexdigest())
            yield batch_of(SCHEMA, [b.column(0), counts, ids_sha, text_sha])

    return docs.selectExpr(f"cast(`{id_col}` as bigint) doc_id", f"`{text_col}` text").mapInArrow(released(run, lambda: chunk_table(model_file).clear()), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
