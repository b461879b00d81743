"""Windows and limits over events, in batch and as streams.

Stream forms take any streaming DataFrame with a ``timestamp`` column; the driver's
``timestamp_ntz`` is cast first, since watermarks refuse it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from harrier.sources.corpus import last_of, upsert


def rate_limited(events: DataFrame, per_minute: int, user: str = "user_id", at: str = "ts", tie: str = "event_id") -> DataFrame:
    """Events with ``minute``, ``turn`` and ``allowed``: the first ``per_minute`` of a user in
    each minute pass."""
    minute = F.date_trunc("minute", F.col(at))
    turn = F.row_number().over(Window.partitionBy(user, "minute").orderBy(at, tie))
    return events.withColumn("minute", minute).withColumn("turn", turn).withColumn("allowed", F.col("turn") <= per_minute)


def daily_budget(events: DataFrame, budget: float, user: str = "user_id", at: str = "ts", cost: str = "value", tie: str = "event_id") -> DataFrame:
    """Events with ``day``, ``spent`` (with this one) and ``within``."""
    w = Window.partitionBy(user, "day").orderBy(at, tie).rowsBetween(Window.unboundedPreceding, 0)
    return events.withColumn("day", F.to_date(at)).withColumn("spent", F.round(F.sum(F.coalesce(cost, F.lit(0.0))).over(w), 6)).withColumn("within", F.col("spent") <= budget)


def sliding_counts(events: DataFrame, width: str = "1 hour", slide: str = "15 minutes", at: str = "ts", by: str = "event_type") -> DataFrame:
    """``(start, by, n, total)`` for each window."""
    grouped = events.groupBy(F.window(at, width, slide), by).agg(F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("total"))
    return grouped.select(F.col("window.start").alias("start"), by, "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", at: str = "ts", user: str = "user_id") -> DataFrame:
    """``(user, start, end, n)``: events of a user less than the gap apart."""
    grouped = events.groupBy(F.session_window(at, gap), user).agg(F.count("*").alias("n"))
    return grouped.select(user, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def stream_of(spark: SparkSession, path: str, at: str = "ts", files_per_trigger: int = 16) -> DataFrame:
    """The Parquet files of a path as a stream, with ``at`` as a timestamp."""
    schema = spark.read.parquet(path).schema
    # as a glob, a path may be a folder or a single file
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(f"{path[:-1]}[{path[-1]}]")
    return rows.withColumn(at, F.col(at).cast("timestamp"))


def streamed_counts(events: DataFrame, late: str = "10 minutes", width: str = "1 hour", at: str = "ts", by: str = "event_type") -> DataFrame:
    """Tumbling counts that close when the watermark passes their end."""
    grouped = events.withWatermark(at, late).groupBy(F.window(at, width), by).agg(F.count("*").alias("n"))
    return grouped.select(F.col("window.start").alias("start"), by, "n")


def streamed_distinct(events: DataFrame, key: str = "event_id", late: str = "10 minutes", at: str = "ts") -> DataFrame:
    """Events without later repeats of their key within the watermark."""
    return events.withWatermark(at, late).dropDuplicatesWithinWatermark([key])


def run_once(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Work off all that is there, write it as Parquet, and read the result."""
    query = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)


def run_updates(stream: DataFrame, path: str, checkpoint: str, keys: list[str]) -> DataFrame:
    """Work off all that is there in update mode: each micro-batch writes the rows it
    changed to a folder named by its number, and the last row of a key counts. So windows
    that the watermark hasn't closed are there too."""

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).outputMode("update").trigger(availableNow=True).start().awaitTermination()
    rows = stream.sparkSession.read.schema(StructType([*stream.schema.fields, StructField("batch", LongType())])).parquet(path)
    values = [c for c in stream.columns if c not in keys]
    return rows.groupBy(*keys).agg(*(F.max_by(c, "batch").alias(c) for c in values))


def upsert_files(stream: DataFrame, table: str, checkpoint: str, key: str = "path") -> None:
    """Incremental indexing: each micro-batch replaces the rows of its keys; of several rows
    of a key in a batch the greatest stays. The new table is written beside the old and
    named by the batch, so a repeated batch is harmless."""
    from pyspark.errors import AnalysisException

    def put(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        try:
            batch = upsert(spark.read.parquet(f"{table}/version={number - 1}"), batch, key)
        except AnalysisException:
            if number:
                raise
            batch = last_of(batch, key)
        batch.write.mode("overwrite").parquet(f"{table}/version={number}")

    stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
