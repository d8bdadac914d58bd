"""Pages as a stream: new files are read as they come, each micro-batch is chunked and appended."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from gristmill.operators import chunking


def page_stream(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 100) -> DataFrame:
    """New Parquet files of pages below a folder; each file is read once."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def chunk_stream(pages: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Chunk the sources of each batch and write them below batch=N; a batch that is run again replaces its own rows.

    A source must come in one batch, as its chunks follow each other.
    """

    def write(batch: DataFrame, number: int) -> None:
        chunking.chunks(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return pages.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
