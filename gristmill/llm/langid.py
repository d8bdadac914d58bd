"""Language identification by compression: the dictionary of the right language compresses a text best."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import batch_of, released, small_batches

SCHEMA = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64()), ("accepted", pa.bool_())])
UNDETERMINED = "und"
#: A lead of fewer bytes than this, or of a smaller share of the size, is too narrow to accept.
MIN_LEAD, MIN_MARGIN = 2, 0.002
_LETTERS = re.compile(r"[^\W\d_]+")


def normalised(text: str) -> bytes:
    """Runs of letters in lower case, joined by one space: capitals, digits and marks say nothing of the language."""
    return " ".join(_LETTERS.findall(text.lower())).encode("utf-8", "surrogatepass")


def fit(docs: DataFrame, training: Column, rows_per_language: int = 512, dictionary_bytes: int = 131_072, total_bytes: int = 67_108_864, broadcast_languages: int = 10_000) -> dict[str, bytes]:
    """A raw-content dictionary for each language from a bounded sample of labelled rows.

    The bound: of each language the ``rows_per_language`` rows of the smallest hash of (doc_id, text), and of each of
    them an equal share of ``dictionary_bytes`` (less where ``total_bytes`` for all languages would be passed). The share is a
    window of the whole text at a place that the hash gives. Rows under a hash threshold of about twice the bound are
    read; equal rows count once. Rows with null text or lang are not used. No rows: no languages.
    """
    spark = docs.sparkSession
    labelled = docs.where(training & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "text", F.xxhash64("doc_id", "text").alias("h"))
    sizes = {r.lang: r.n for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return {}
    each = max(1024, min(dictionary_bytes, total_bytes // len(sizes)))
    # characters to read of a row: twice its share, as not all are letters
    limits = spark.createDataFrame([(lang, min(1.0, 2.0 * rows_per_language / n + 0.001), 2 * -(-each // min(n, rows_per_language))) for lang, n in sizes.items()], "lang string, share double, chars int")
    chosen = labelled.join(F.broadcast(limits) if len(sizes) <= broadcast_languages else limits, "lang").where(F.col("h") / 2.0**64 + 0.5 <= F.col("share"))
    first = 1 + F.pmod(F.xxhash64("h"), F.greatest(F.length("text") - F.col("chars") + 1, F.lit(1)))
    rows = chosen.select("lang", "h", F.substr("text", first.cast("int"), F.col("chars")).alias("part")).dropDuplicates(["lang", "h"]).collect()
    by: dict[str, list[tuple[int, str]]] = {}
    for r in rows:
        by.setdefault(r.lang, []).append((r.h, r.part))
    found = {}
    for lang, held in by.items():
        parts = [normalised(t) for _, t in sorted(held)[:rows_per_language]]
        # rows that have less than their share leave it to the others
        share = each // len(parts)
        while share < each and sum(min(len(p), share) + 1 for p in parts) < each and any(len(p) > share for p in parts):
            share += max(1, share // 8)
        found[lang] = b"\n".join(p[:share] for p in reversed(parts))[-each:]
    return {lang: d for lang, d in found.items() if d.strip()}


class Classifier:
    """Sizes of a text under each language's dictionary; every ``segment`` bytes are compressed anew."""

    def __init__(self, dictionaries: dict[str, bytes], level: int = 9, segment: int = 4096, min_lead: int = MIN_LEAD, min_margin: float = MIN_MARGIN):
        import zstandard

        self.segment, self.coders, self.min_lead, self.min_margin = segment, [], min_lead, min_margin
        for lang in sorted(dictionaries):
            held = zstandard.ZstdCompressionDict(dictionaries[lang], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            held.precompute_compress(level=level)
            self.coders.append((lang, zstandard.ZstdCompressor(level=level, dict_data=held, write_content_size=False, write_checksum=False, write_dict_id=False)))

    def sizes(self, text: str) -> list[int]:
        data = normalised(text)
        cuts = [data[i : i + self.segment] for i in range(0, len(data), self.segment)]
        return [sum(len(c.compress(x)) for x in cuts) for _, c in self.coders]

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """The language of the smallest size (ties: the first name), the margin of the second over it, and whether the lead is wide enough."""
        if not self.coders or not text or not any(map(str.isalpha, text)):
            return UNDETERMINED, 0.0, False
        sizes = self.sizes(text)
        best = min(range(len(sizes)), key=sizes.__getitem__)
        second = min((s for i, s in enumerate(sizes) if i != best), default=2 * sizes[best])
        lead = second - sizes[best]
        return self.coders[best][0], min(1.0, max(0.0, lead / second)), lead >= max(self.min_lead, self.min_margin * second)


def predict(docs: DataFrame, dictionaries: dict[str, bytes], min_lead: int = MIN_LEAD, min_margin: float = MIN_MARGIN) -> DataFrame:
    """doc_id, lang_pred, score (relative margin, 0 to 1) and accepted for every row, from its text alone.

    Null texts and texts without a letter are ``und`` with score 0 and not accepted; leads under ``min_lead``
    bytes or ``min_margin`` of the second size are not accepted. Whole texts; repeated rows give repeated results; other columns
    are not read. Narrow: no shuffle. The dictionaries are bounded (see fit) and travel in the closure.
    """

    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Classifier(dictionaries, min_lead=min_lead, min_margin=min_margin)
        for b in batches:
            found = [model.predict(t.as_py()) for t in b.column(1)]
            yield batch_of(SCHEMA, [b.column(0), *([f[k] for f in found] for k in range(3))])

    return docs.selectExpr("cast(doc_id as bigint) doc_id", "text").mapInArrow(released(run), "doc_id long, lang_pred string, score double, accepted boolean")


def accepted_rows(docs: DataFrame, dictionaries: dict[str, bytes], min_lead: int = MIN_LEAD, min_margin: float = MIN_MARGIN) -> DataFrame:
    """The rows of docs, all columns as they are, whose language is predicted with a margin that isn't narrow. No shuffle."""
    place = docs.columns.index("text")

    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Classifier(dictionaries, min_lead=min_lead, min_margin=min_margin)
        for b in batches:
            yield b.filter(pa.array([model.predict(t.as_py())[2] for t in b.column(place)], pa.bool_()))

    return docs.mapInArrow(released(run), docs.schema)
