"""The reference's incremental runs as streams: append as items come, never twice, and go on where a run ended."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery


def incoming(spark: SparkSession, folder: str, schema: T.StructType | str, files_per_trigger: int = 100) -> DataFrame:
    """New JSON-lines files of a folder as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).json(folder)


def fresh(stream: DataFrame, keys: list[str], event_time: str, lateness: str, history: DataFrame | None = None) -> DataFrame:
    """Items whose key came neither in the history nor before in the stream, however late they or their repeats come.

    No watermark: it would drop late items with new keys and let repeats through after the lateness, so `event_time` and
    `lateness` have no effect. The state is one entry for each key of the stream and is never cut; at many keys a session
    should set the RocksDB state store. A checkpoint made with the watermark can't be gone on with.
    """
    out = stream.dropDuplicates(keys)
    return out if history is None else out.join(history.select(*keys).distinct(), keys, "left_anti")


def append_each(stream: DataFrame, path: str, checkpoint: str, step: Callable[[DataFrame], DataFrame] = lambda df: df) -> StreamingQuery:
    """Run a step over each batch and append its rows, then stop when all input is done; the checkpoint lets a later call go on.

    A batch that is run again after a failure writes into the same folder of its number, so no row comes twice.
    """

    def write(df: DataFrame, number: int) -> None:
        step(df).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(stream: DataFrame, event_time: str, kind: str, width: str, lateness: str) -> DataFrame:
    """Counts by window and kind; late items count until the watermark has passed their window."""
    return stream.withWatermark(event_time, lateness).groupBy(F.window(event_time, width).alias("w"), kind).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("window_start"), kind, "n")
