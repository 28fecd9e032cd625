"""Incremental behaviour as Structured Streaming: append and resume, keep-last, threshold timers, windows."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from penumbra.operators.graph import checkpoint_folder


def read_events(spark: SparkSession, folder: str, pattern: str = "events.parquet") -> DataFrame:
    """A file source over Parquet under the schema that the folder has now."""
    schema = spark.read.parquet(f"{folder}/{pattern}").schema
    if spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{pattern}").getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{pattern}")).isDirectory():
        return spark.readStream.schema(schema).parquet(f"{folder}/{pattern}")
    return spark.readStream.schema(schema).option("pathGlobFilter", pattern).parquet(folder)


def run_to_end(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Runs a stream over what is there now and returns its table, written as Parquet under the checkpoint folder.

    Each batch has a folder of its own, so that a batch that runs again replaces itself; in complete mode the last one is the table.
    """
    spark = stream.sparkSession
    folder = f"{checkpoint_folder(spark)}/stream-{uuid.uuid4().hex}"
    last = [-1]

    def each(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/rows/batch={number}")
        last[0] = number

    q = stream.writeStream.foreachBatch(each).outputMode(mode).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    if last[0] < 0:
        return spark.createDataFrame([], stream.schema)
    at = f"{folder}/rows/batch={last[0]}" if mode == "complete" else f"{folder}/rows/*"
    return spark.read.schema(stream.schema).parquet(at)


def keep_last(stream: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The last row of each key so far, by order; for complete or update mode."""
    rest = [c for c in stream.columns if c not in keys]
    return stream.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("__r")).select(*keys, "__r.*")


def hourly_counts(stream: DataFrame, at: str, by: str, late: str = "1 hour") -> DataFrame:
    """Counts in tumbling hours behind a watermark."""
    return stream.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late).groupBy(F.window(at, "1 hour"), by).agg(F.count("*").alias("n")).select(F.col("window.start").alias("hour"), by, "n")


def upsert_sink(stream: DataFrame, path: str, keys: list[str], checkpoint: str, work: Callable[[DataFrame], DataFrame] = lambda d: d):
    """Writes the batches of a stream as appended Parquet of keys not yet there; started again, it goes on where it stopped."""
    from penumbra.sources.writers import append, missing

    def each(batch: DataFrame, _: int) -> None:
        append(work(missing(batch, path, keys).dropDuplicates(keys)), path)

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def over_threshold(stream: DataFrame, key: str, at: str, value: str, threshold: float) -> DataFrame:
    """(key, at_s, value, held) with held: whole seconds since the value went over the threshold without a drop; state per key across batches.

    The rows of a key in one batch of the stream are sorted by time, then value, across all frames they come in; so a task holds
    the rows of one key in one batch, which the limits of the source (maxFilesPerTrigger, maxBytesPerTrigger) bound. Null values are no excess.
    """
    import pandas as pd
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def each(k, frames, state: GroupState):
        since = state.get[0] if state.exists else None
        pdf = pd.concat(list(frames)).sort_values(["at_s", "value"], kind="stable")
        out = []
        for t, v in zip(pdf["at_s"], pdf["value"], strict=True):
            since = None if not v > threshold else t if since is None else since
            out.append(0 if since is None else t - since)
        yield pd.DataFrame({"key": k[0], "at_s": pdf["at_s"], "value": pdf["value"], "held": out})
        state.update((since,))

    rows = stream.select(F.col(key).cast("long").alias("key"), F.unix_seconds(F.col(at).cast("timestamp")).alias("at_s"), F.col(value).cast("double").alias("value"))
    return rows.groupBy("key").applyInPandasWithState(each, "key long, at_s long, value double, held long", "since long", "append", GroupStateTimeout.NoTimeout)
