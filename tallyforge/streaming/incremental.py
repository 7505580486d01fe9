"""Statistics of result files while they are still written, and event windows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def follow(spark: SparkSession, path: str, schema: str, files_per_batch: int = 16, fmt: str = "json") -> DataFrame:
    """A stream over a folder to which files are added; so many files a batch hold back the rest."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).format(fmt).load(path)


def running_rates(rows: DataFrame, by: str = "design_family") -> DataFrame:
    """Counts and rates by family; the same expression serves streams and tables, and its state is a row a family."""
    ok = F.col("is_correct").cast("double")
    return rows.groupBy(by).agg(F.count("*").alias("n"), F.avg(ok).alias("accuracy"), F.avg((F.col("detected") == F.col(by)).cast("double")).alias("match_rate"))


def event_windows(events: DataFrame, late: str = "10 minutes", size: str = "1 hour", slide: str | None = None) -> DataFrame:
    """Events and values of each window and type, as far as the watermark has passed."""
    window = F.window("ts", size, slide) if slide else F.window("ts", size)
    events = events.withColumn("ts", F.col("ts").cast("timestamp"))  # a watermark needs a time zone
    return events.withWatermark("ts", late).groupBy(window, "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def append(stream: DataFrame, path: str, checkpoint: str, fmt: str = "json") -> StreamingQuery:
    """Each row once into files, as they come; ends when all that is there has been read."""
    return stream.writeStream.format(fmt).option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def append_once(stream: DataFrame, path: str, checkpoint: str, key: list[str], time: str | None = None, late: str | None = None, fmt: str = "parquet") -> StreamingQuery:
    """The first row of each key into files, however often it is delivered, and whichever batch is run again after a failure.

    Keys that were seen are state of the stream. With `time` and `late` a key is kept until the watermark, the latest time
    less `late`, has passed it; rows from before the watermark are taken for repeats. Without them all keys are kept.
    The files' log tells which batches are in: read the folder with `appended`.
    """
    if time is None or late is None:
        once = stream.dropDuplicates(key)
    else:
        once = stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late).dropDuplicatesWithinWatermark(key)
    return append(once, path, checkpoint, fmt)


def appended(spark: SparkSession, path: str, fmt: str = "parquet", schema: str | None = None) -> DataFrame:
    """What batches that ended have appended; files of one that broke off don't count."""
    reader = spark.read.format(fmt)
    return (reader.schema(schema) if schema is not None else reader).load(path)


def append_batches(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Each batch into a folder of its own number: one that is run again overwrites what it has written."""
    return into(stream, lambda df, n: df.write.mode("overwrite").parquet(f"{path}/batch={n}"), checkpoint, "append")


def into(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "update") -> StreamingQuery:
    """Each batch to a function (rows, number of the batch), which may see a batch again after a failure."""
    return stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()


def to_table(stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """The complete result after all that is there: each batch overwrites it."""
    into(stream, lambda df, _: df.write.mode("overwrite").parquet(path), checkpoint, "complete").awaitTermination()
    return stream.sparkSession.read.parquet(path)
