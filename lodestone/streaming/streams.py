"""Streams of events (STR-01 to STR-07) with Structured Streaming.

Each function takes a streaming frame and gives one; ``run_available`` runs one over all input there is and ends, with its
checkpoint in the session's shared folder.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lodestone.tables import checkpoint_dir


def read_events(spark: SparkSession, folder: str, name: str = "events", time: str = "ts", files: int = 1000) -> DataFrame:
    """STR-01: the files of a table as a stream, with its time as a timestamp that watermarks accept."""
    path = f"{folder}/{name}.parquet"
    schema = spark.read.parquet(path).schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).option("pathGlobFilter", "*.parquet")
    if not _is_folder(spark, path):  # a stream reads folders: take the file by its name
        stream, path = stream.option("pathGlobFilter", f"{name}.parquet"), folder
    return stream.parquet(path).withColumn(time, F.col(time).cast("timestamp"))


def _is_folder(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return bool(p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory())


def read_files(spark: SparkSession, folder: str, files: int = 100) -> DataFrame:
    """STR-05: new files of a folder with their bytes, as they come."""
    schema = "path string, modificationTime timestamp, length bigint, content binary"
    return spark.readStream.format("binaryFile").schema(schema).option("maxFilesPerTrigger", files).load(folder)


def tumbling_counts(events: DataFrame, time: str, by: str, value: str, width: str = "1 hour", late: str = "1 day") -> DataFrame:
    """STR-03: count and sum of a value by window and kind."""
    w = events.withWatermark(time, late).groupBy(F.window(time, width).alias("w"), by)
    return w.agg(F.count("*").alias("n"), F.round(F.sum(value), 4).alias("total")).select(F.col("w.start").alias("from_time"), by, "n", "total")


def sessions(events: DataFrame, time: str, by: str, gap: str = "6 hours", late: str = "1 day") -> DataFrame:
    """STR-06: sessions of events that are at most ``gap`` apart."""
    s = events.withWatermark(time, late).groupBy(F.session_window(time, gap).alias("w"), by).agg(F.count("*").alias("n"))
    return s.select(by, F.col("w.start").alias("from_time"), F.col("w.end").alias("to_time"), "n")


def once_each(events: DataFrame, time: str, key: str, late: str = "7 days") -> DataFrame:
    """STR-07: each key once within the watermark; rows without a key are left out."""
    return events.where(F.col(key).isNotNull()).withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def running_means(events: DataFrame, by: str, time: str, value: str, alpha: float = 0.1) -> DataFrame:
    """STR-04, WN-09: the exponential mean of each group as state that goes on from batch to batch, in the order of time within a batch."""

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        mean, n = state.get if state.exists else (0.0, 0)
        rows = pd.concat(list(parts)).sort_values([time, value])
        for x in rows[value].dropna():
            mean, n = alpha * float(x) + (1 - alpha) * mean, n + 1
        state.update((mean, n))
        yield pd.DataFrame({by: [key[0]], "ema": [mean], "n": [n]})

    kind = events.schema[by].dataType.simpleString()
    out = f"`{by}` {kind}, ema double, n bigint"
    return events.select(by, time, value).groupBy(by).applyInPandasWithState(step, out, "ema double, n bigint", "update", GroupStateTimeout.NoTimeout)


def run_available(stream: DataFrame, mode: str, each: Callable[[DataFrame, int], None] | None = None) -> DataFrame | None:
    """Runs a stream over all there is.  With ``each`` every batch goes there; else the rows are written and given back.

    In complete mode each batch replaces the one before, so its number is part of the folder that is read in the end.
    """
    spark = stream.sparkSession
    root = f"{checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"
    last: list[int] = []

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/out/batch={number}")
        last.append(number)

    query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{root}/state").foreachBatch(each or write).trigger(availableNow=True).start()
    query.awaitTermination()
    if each:
        return None
    if not last:  # a stream without a row has no batch
        return spark.createDataFrame([], stream.schema)
    if mode == "complete":
        return spark.read.parquet(f"{root}/out/batch={max(last)}")
    return spark.read.parquet(f"{root}/out").drop("batch")
