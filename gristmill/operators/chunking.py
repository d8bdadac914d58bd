"""Cutting page-structured documents into chunks that keep their pages and section."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gristmill.functions import text as T

CHUNK = "chunk_id string, source_id string, ordinal int, page_from int, page_to int, section string, text string, tokens int, quality double, image string"


@dataclass(frozen=True)
class Limits:
    """Token targets of a chunk. ``overlap`` is the share of the target that a carried paragraph may have."""

    target: int = 550
    most: int = 800
    least: int = 60
    overlap: float = 0.15


class Accumulator:
    """Blocks of one source in order -> chunks. A chunk too small to stand alone stays in the buffer and grows."""

    def __init__(self, source_id: str, limits: Limits):
        self.source, self.limits = source_id, limits
        self.parts: list[tuple] = []  # (text, page, quality, image, tokens)
        self.section, self.count, self.out = "", 0, []

    @property
    def tokens(self) -> int:
        return sum(p[4] for p in self.parts)

    def close(self, carry: bool = True, force: bool = False) -> bool:
        """Emit the buffer if it is large enough or must go. Afterwards a short last paragraph opens the next chunk."""
        text = "\n\n".join(p[0] for p in self.parts).strip()
        if not self.parts or not text or (self.tokens < self.limits.least and not force):
            return False
        self.count += 1
        pages = [p[1] for p in self.parts]
        self.out.append((f"{self.source}#{self.count:05d}", self.source, self.count, min(pages), max(pages), self.section, text, self.tokens, round(sum(p[2] for p in self.parts) / len(self.parts), 3), self.parts[0][3]))
        last = self.parts[-1]
        self.parts = [last] if carry and len(self.parts) > 1 and last[4] <= self.limits.target * self.limits.overlap else []
        return True

    def heading(self, text: str, page: int, quality: float, image: str | None, tokens: int) -> None:
        closed = self.close(carry=False)
        if closed or not self.parts:
            self.section = text
        else:
            self.parts.append((text, page, quality, image, tokens))

    def paragraph(self, pieces: list[tuple[str, int]], page: int, quality: float, image: str | None) -> None:
        """A paragraph as its pieces: one, or the packed sentences of an oversized one."""
        if len(pieces) == 1 and pieces[0][1] <= self.limits.most:
            if self.tokens + pieces[0][1] > self.limits.most:
                self.close()
        else:
            self.close()
        for text, tokens in pieces:
            self.parts.append((text, page, quality, image, tokens))
            if self.tokens >= self.limits.target:
                self.close()


def page_blocks(pages: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """(source_id, page, pos, is_heading, pieces, quality, image) of the paragraphs of every page, tokens estimated natively."""
    each = pages.select("source_id", "page", "quality", "image", F.posexplode(T.blocks(F.coalesce("text", F.lit("")))).alias("pos", "b"))
    text, tokens = F.col("b.text"), T.token_estimate(F.col("b.text"))
    whole = F.array(F.struct(text.alias("text"), tokens.alias("tokens")))
    cut = F.transform(T.sentences_packed(text, limits.target), lambda s: F.struct(s.alias("text"), T.token_estimate(s).alias("tokens")))
    return each.select("source_id", "page", "pos", F.col("b.is_heading").alias("is_heading"), F.when((tokens > limits.most) & ~F.col("b.is_heading"), cut).otherwise(whole).alias("pieces"), "quality", "image")


def chunks(pages: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """Chunks of every source. pages: (source_id, page, text, quality, image).

    Paragraphs, headings and tokens come from native functions; only the accumulation, whose state is reset by
    what it emits, is sequential, over the sorted blocks of one source as a stream of Arrow batches: its memory is one chunk, not one source.
    """
    blocks = page_blocks(pages, limits)
    ordered = blocks.repartition("source_id").sortWithinPartitions("source_id", "page", "pos")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in CHUNK.split(", ")]
        held: Accumulator | None = None
        for b in batches:
            out = []
            for r in b.itertuples(index=False):
                if held is None or held.source != r.source_id:
                    if held is not None:
                        held.close(carry=False, force=True)
                        out += held.out
                    held = Accumulator(r.source_id, limits)
                pieces = [(p["text"], int(p["tokens"])) for p in r.pieces]
                quality = 1.0 if pd.isna(r.quality) else float(r.quality)
                if r.is_heading:
                    held.heading(pieces[0][0], int(r.page), quality, r.image, pieces[0][1])
                else:
                    held.paragraph(pieces, int(r.page), quality, r.image)
                out += held.out
                held.out = []
            if out:
                yield pd.DataFrame(out, columns=names)
        if held is not None:
            held.close(carry=False, force=True)
            if held.out:
                yield pd.DataFrame(held.out, columns=names)

    return ordered.mapInPandas(run, CHUNK)


def with_source_facts(found: DataFrame, sources: DataFrame) -> DataFrame:
    """Chunks with priority and language of their source, where the manifest knows it."""
    return found.join(sources.select(F.col("id").alias("source_id"), "priority", "lang"), "source_id", "left")


def chunk_report(found: DataFrame) -> DataFrame:
    return found.groupBy("source_id").agg(F.count("*").alias("chunks"), F.round(F.avg("tokens"), 1).alias("mean_tokens"))


def page_report(pages: DataFrame, low: float = 0.55) -> DataFrame:
    """Pages, OCR pages, pages of low quality and the mean of those, by source."""
    bad = F.col("quality") < low
    return pages.groupBy("source_id").agg(F.count("*").alias("pages"), F.count_if("ocr").alias("ocr_pages"), F.count_if(bad).alias("low_pages"), F.round(F.avg(F.when(bad, F.col("quality"))), 3).alias("mean_low"))


def embedding_text() -> F.Column:
    """What of a chunk is embedded: its section and text, as a title often says what the paragraph doesn't."""
    section = F.coalesce("section", F.lit(""))
    return F.when(section != "", T.strip(F.concat(section, F.lit("\n"), "text"))).otherwise(F.col("text"))
