"""New monthly files as a stream: each file is read once, ``availableNow`` ends when none is left,
and the checkpoint remembers what was read. The counts of day-hours follow a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType


def leg_stream(spark: SparkSession, folder: str, schema: StructType, files_per_batch: int = 16) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def hourly_movements(stream: DataFrame, late: str = "2 days") -> DataFrame:
    """Scheduled departures of a node and hour; rows later than the watermark are left out."""
    timed = stream.withColumn("at", F.col("sched_dep").cast("timestamp")).withWatermark("at", late)
    return timed.groupBy("origin_node", F.window("at", "1 hour").alias("w")).agg(F.count(F.lit(1)).alias("movements")).select(F.col("origin_node").alias("node"), F.col("w.start").alias("hour"), "movements")


def append_available(df: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Write what is there now and end."""
    return df.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
