"""The index on disk: Parquet tables and a table of metadata, and the checks on opening it."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.functions.vectors import decode_probe
from gristmill.operators import lexical
from gristmill.sources.scratch import materialised

SCHEMA_VERSION = "1"


class IndexMismatch(RuntimeError):
    """The index was built with another embedder."""


@dataclass
class Index:
    chunks: DataFrame
    sources: DataFrame
    postings: DataFrame
    meta: dict[str, str]


def numbered(chunks: DataFrame) -> DataFrame:
    """rowid from 0 in the order of source and ordinal, from counts for each source, not from one sorted task."""
    from pyspark.sql import Window

    # sums over 1024 ranges of sources first, so that no task sees all sources
    sizes = chunks.groupBy("source_id").agg(F.count("*").alias("n")).repartitionByRange(1024, "source_id").withColumn("range", F.spark_partition_id())
    sizes = materialised(sizes)
    ranges = sizes.groupBy("range").agg(F.sum("n").alias("n"))
    before = ranges.select("range", F.coalesce(F.sum("n").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    own = Window.partitionBy("range").orderBy("source_id").rowsBetween(Window.unboundedPreceding, -1)
    base = sizes.withColumn("within", F.coalesce(F.sum("n").over(own), F.lit(0))).join(F.broadcast(before), "range").select("source_id", (F.col("before") + F.col("within")).alias("base"))
    return chunks.join(base, "source_id").withColumn("rowid", F.col("base") + F.col("ordinal") - 1).drop("base")


def build(chunks: DataFrame, sources: DataFrame, path: str, embedder: dict[str, str] | None = None, probe: str = "") -> None:
    """Write chunks (with rowid; embedding optional), the sources they use, postings and metadata. Existing tables are replaced.

    Raises ValueError if some rows have an embedding and others none. Postings are range-partitioned by key, so a lookup reads few files.
    """
    counts = chunks.agg(F.count("*").alias("n"), F.count("embedding" if "embedding" in chunks.columns else F.lit(1)).alias("v"), F.countDistinct("source_id").alias("s")).first()
    if counts.v not in (0, counts.n):
        raise ValueError(f"{counts.n} chunks but {counts.v} vectors")
    chunks.write.mode("overwrite").parquet(f"{path}/chunks")
    held = chunks.sparkSession.read.parquet(f"{path}/chunks")
    used_sources(sources, held).write.mode("overwrite").parquet(f"{path}/sources")
    lexical.postings(held).repartitionByRange("kind", "key", "rowid").sortWithinPartitions("kind", "key").write.mode("overwrite").parquet(f"{path}/postings")
    meta = {"schema_version": SCHEMA_VERSION, "chunk_count": str(counts.n), "source_count": str(counts.s), "embed_probe": probe} | (embedder or {})
    rows = held.sparkSession.createDataFrame([*meta.items()], "key string, value string")
    rows.unionByName(rows.limit(1).select(F.lit("built_at").alias("key"), F.current_timestamp().cast("string").alias("value"))).write.mode("overwrite").parquet(f"{path}/meta")


def open_index(spark: SparkSession, path: str) -> Index:
    from pyspark.errors import AnalysisException

    try:
        meta = {r.key: r.value for r in spark.read.parquet(f"{path}/meta").collect()}
    except AnalysisException as e:
        raise FileNotFoundError(f"no index at {path}: build it first") from e
    read = lambda n: spark.read.parquet(f"{path}/{n}")
    return Index(read("chunks"), read("sources"), read("postings"), meta)


def check_embedder(meta: dict[str, str], name: str, backend: str = "") -> None:
    """The model's name must be the index's; the backend too where both are known."""
    if meta.get("embed_model", "?") != name:
        raise IndexMismatch(f"index of {meta.get('embed_model', '?')}, embedder {name}")
    if backend and meta.get("embed_backend") and meta["embed_backend"] != backend:
        raise IndexMismatch(f"index by {meta['embed_backend']}, embedder by {backend}")


def check_probe(meta: dict[str, str], vector: np.ndarray, least: float = 0.99) -> None:
    """The probe phrase must still encode to nearly the stored vector; without a stored one there is nothing to check."""
    stored = decode_probe(meta.get("embed_probe"))
    if stored is None:
        return
    if len(stored) != len(vector):
        raise IndexMismatch(f"{len(stored)} dimensions in the index, {len(vector)} from the embedder")
    cosine = float(stored @ vector / max(float(np.linalg.norm(stored) * np.linalg.norm(vector)), 1e-9))
    if cosine < least:
        raise IndexMismatch(f"the probe's cosine is {cosine:.3f}")


def used_sources(sources: DataFrame, chunks: DataFrame) -> DataFrame:
    """The sources that have a chunk."""
    return sources.join(chunks.select(F.col("source_id").alias("id")), "id", "left_semi")


def source_stats(sources: DataFrame, chunks: DataFrame) -> DataFrame:
    """(id, title, chunks) of every source, those without chunks too."""
    n = chunks.groupBy(F.col("source_id").alias("id")).agg(F.count("*").alias("chunks"))
    return sources.join(n, "id", "left").select("id", "title", F.coalesce("chunks", F.lit(0)).alias("chunks"))


def passages(chunks: DataFrame, sources: DataFrame, rowids: DataFrame) -> DataFrame:
    """Chunks of the given rows with their source's facts; chunks of unknown sources drop out."""
    from gristmill.operators.fusion import defaults

    held = defaults(chunks.join(rowids.select("rowid"), "rowid", "left_semi"))
    return held.join(sources.select(F.col("id").alias("source_id"), "title", F.coalesce("author", F.lit("")).alias("author"), "date", "licence"), "source_id")
