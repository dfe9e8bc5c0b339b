"""Streaming ingestion: new files of prompts as they come, each run key once within a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..operators import registry as R


def source(spark: SparkSession, path: str, schema: StructType, files_per_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def once(events: DataFrame, time: str = "ts", key: str = "run_key", late: str = "10 minutes") -> DataFrame:
    """The first event of each key; state is kept as long as late events may come."""
    return events.withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def windowed_counts(events: DataFrame, time: str = "ts", width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    return events.withWatermark(time, late).groupBy(F.window(time, width), "status").agg(F.count(F.lit(1)).alias("n"))


def first_of(events: DataFrame, keys: list[str]) -> DataFrame:
    """One event of each key, the same however the events are dealt out: the first by all its columns."""
    rest = [c for c in events.columns if c not in keys]
    if not rest:
        return events.distinct()
    return events.groupBy(*keys).agg(F.min(F.struct(*rest)).alias("_first")).select(*(F.col(c) if c in keys else F.col(f"_first.{c}").alias(c) for c in events.columns))


def append_unprocessed(events: DataFrame, runs_path: str, checkpoint: str, keys: tuple[str, ...] = ("run_key", "processing_fingerprint")) -> StreamingQuery:
    """Appends to the table of runs, batch by batch, the events that no completed run there has; for all files there are now.

    A run is completed for its key and its settings: the same key with others is new. Of keys, those that the events have
    count. A batch that is tried again finds its own rows and adds none.
    """
    own = [key for key in keys if key in events.columns]

    def batch(df: DataFrame, _: int) -> None:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(runs_path)
        known = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)
        new = first_of(df, own)
        new = R.unprocessed(new, spark.read.parquet(runs_path), own) if known else new
        new.withColumn("status", F.lit("completed")).write.mode("append").parquet(runs_path)

    return events.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
