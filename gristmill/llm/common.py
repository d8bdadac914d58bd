"""Helpers shared by the operators: word rules, the shared scratch folder, packed exchanges."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The six word separators (space, tab, LF, VT, FF, CR); ``bytes.split()`` splits at just these.
SEPARATORS = "\\x20\\x09-\\x0D"
ASCII_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir; only a local master may do without that setting."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = "/tmp/checkpoints"
    return os.path.join(base, f"gristmill-{uuid.uuid4().hex}")


#: Folders of intermediate tables, by application; discard() empties the list.
_WRITTEN: dict[str, list[str]] = {}


def written(df: DataFrame) -> DataFrame:
    """df as a zstd Parquet table in the shared folder, read again: lineage ends and later passes reuse it.

    What an operator returns may read such tables; discard() takes them away once that result is stored.
    """
    spark = df.sparkSession
    path = shared_dir(spark)
    df.write.option("compression", "zstd").parquet(path)
    _WRITTEN.setdefault(spark.sparkContext.applicationId, []).append(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, *paths: str) -> None:
    """Delete the folders at ``paths``, and all intermediate tables that operators have written in this application so far."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for path in [*paths, *_WRITTEN.pop(spark.sparkContext.applicationId, [])]:
        place = jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(conf).delete(place, True)


def small_batches(spark: SparkSession, most: int = 16_777_216) -> None:
    """Arrow batches of this session have ``most`` bytes at most from now on: a batch stands several times in an executor's
    memory, outside of the heap and in its workers."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    held = spark.conf.get(name, None)
    if held is None or not held.rstrip("b").isdigit() or not 0 < int(held.rstrip("b")) <= most:
        spark.conf.set(name, str(most))


def exchange_width(df: DataFrame) -> int:
    """Partitions for a packed exchange: the session's shuffle width, or the input's splits if those are more."""
    spark = df.sparkSession
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), df.rdd.getNumPartitions())


def held_out(doc_id: Column | str, modulus: int, remainder: int) -> Column:
    return F.crc32(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id.cast("string")) % modulus == remainder


def words_of(text: str | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` as UTF-8; null and empty texts have none."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


def batch_of(schema: pa.Schema, columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


#: Longer keys are computed anew each time: a cache never holds them.
LONGEST_KEY = 256


class WordHashes(dict):
    """64-bit hash of a word; the table is emptied at ``most`` entries and holds no key over LONGEST_KEY bytes, so its memory is bounded."""

    def __init__(self, most: int = 200_000):
        import xxhash

        super().__init__()
        self.most, self._hash = most, xxhash.xxh3_64_intdigest

    def __missing__(self, word: bytes) -> int:
        h = self._hash(word)
        if len(word) <= LONGEST_KEY:
            if len(self) >= self.most:
                self.clear()
            self[word] = h
        return h


def released(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], *tables: Callable[[], None]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, and after its last batch the worker process hands free memory back, as it waits for other tasks; ``tables`` empty what it caches."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ctypes

        yield from run(batches)
        for empty in (forget_powers, *tables):
            empty()
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim is not None:
            trim(0)

    return whole


#: Odd bases of two independent window hashes.
BASE, OTHER_BASE = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        size = 1 << max(16, (n - 1).bit_length())
        have = np.full(size, base, np.uint64)
        have[0] = 1
        have = _POWERS[base] = np.cumprod(have, dtype=np.uint64)
    return have[:n]


def forget_powers(most: int = 1 << 20) -> None:
    """Drop powers that only a very long text needed, so that a worker process doesn't keep them."""
    for base in [b for b, held in _POWERS.items() if len(held) > most]:
        del _POWERS[base]


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser: every bit of the result depends on every bit of h."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def window_hashes(hashes: np.ndarray, length: int, base: int = BASE) -> np.ndarray:
    """Hash of every window of ``length`` consecutive words, from prefix sums of a polynomial modulo 2**64."""
    n = len(hashes)
    if n < length:
        return np.empty(0, np.uint64)
    prefix = np.zeros(n + 1, np.uint64)
    np.cumsum(hashes * _powers(base, n), out=prefix[1:], dtype=np.uint64)
    return mixed((prefix[length:] - prefix[:-length]) * _powers(pow(base, -1, 2**64), n - length + 1))
