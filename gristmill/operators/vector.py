"""Exact vector retrieval by blocks of matrix products."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SCORED = "qid long, rowid long, score double"
_SCHEMA = pa.schema([("qid", pa.int64()), ("rowid", pa.int64()), ("score", pa.float64())])


def _best(ids: np.ndarray, questions: np.ndarray, rows: np.ndarray, vectors: np.ndarray, k: int, digits: int) -> list[np.ndarray]:
    """qid, rowid and score of the k best rows of each question, and ties of the last; products in float64."""
    products = np.round(questions @ vectors.T, digits)
    if len(rows) > k:
        last = np.partition(products, len(rows) - k, axis=1)[:, -k][:, None]
        q, r = np.nonzero(products >= last)
    else:
        q, r = np.divmod(np.arange(products.size), max(1, len(rows)))
    return [ids[q], rows[r].astype(np.int64), products[q, r]]


def scored(queries: DataFrame, vectors: DataFrame, k: int = 50, digits: int = 6, held_queries: int = 4096, block_queries: int = 2048, block_rows: int = 20_000) -> DataFrame:
    """(qid, rowid, score): for each question the k best rows of each block of vectors, and ties of the last.

    Up to ``held_queries`` questions, which are counted first, go to the tasks whole, and a task multiplies an Arrow batch at a
    time. More of them are a table: blocks of questions meet blocks of vectors in a co-group, so neither side is
    ever held by one process. Null vectors are left out.
    """
    asked = queries.where("embedding is not null").select("qid", "embedding")
    held = vectors.where("embedding is not null").select("rowid", "embedding")
    first = asked.limit(held_queries + 1).collect()
    if len(first) > held_queries:
        return _crossed(asked, held, k, digits, block_queries, block_rows)
    ids, matrix = np.array([a[0] for a in first], np.int64), np.array([a[1] for a in first], np.float64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows and len(ids):
                x = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1).astype(np.float64)
                yield pa.RecordBatch.from_arrays([*map(pa.array, _best(ids, matrix, b.column(0).to_numpy(), x, k, digits))], schema=_SCHEMA)

    return held.mapInArrow(run, SCORED)


def _crossed(asked: DataFrame, held: DataFrame, k: int, digits: int, block_queries: int, block_rows: int) -> DataFrame:
    blocks, shards = -(-asked.count() // block_queries), max(1, -(-held.count() // block_rows))
    spread = lambda df, own, n, other, m, by: df.withColumn(own, F.pmod(F.xxhash64(by), F.lit(n)).cast("int")).withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(m - 1))))
    left, right = spread(asked, "block", blocks, "shard", shards, "qid"), spread(held, "shard", shards, "block", blocks, "rowid")

    def score(q, x):  # noqa: ANN001, ANN202
        import pandas as pd

        if not len(q) or not len(x):
            return pd.DataFrame({"qid": [], "rowid": [], "score": []}).astype({"qid": "int64", "rowid": "int64", "score": "float64"})
        matrix = lambda c: np.stack(c.to_numpy()).astype(np.float64)
        return pd.DataFrame(dict(zip(("qid", "rowid", "score"), _best(q["qid"].to_numpy(), matrix(q["embedding"]), x["rowid"].to_numpy(), matrix(x["embedding"]), k, digits))))

    return left.groupBy("block", "shard").cogroup(right.groupBy("block", "shard")).applyInPandas(score, SCORED)


def top_k(queries: DataFrame, vectors: DataFrame, k: int = 50, digits: int = 6) -> DataFrame:
    """(qid, rowid, score, rank) of the k largest dot products; ties to the smaller rowid."""
    order = Window.partitionBy("qid").orderBy(F.desc("score"), "rowid")
    return scored(queries, vectors, k, digits).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def best_cosine(queries: DataFrame, vectors: DataFrame, digits: int = 6) -> DataFrame:
    """(qid, cos_max) over all vectors."""
    return scored(queries, vectors, 1, digits).groupBy("qid").agg(F.max("score").alias("cos_max"))
