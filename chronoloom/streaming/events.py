"""Event logs as streams: tumbling counts with a watermark, and the last state of each run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_stream(spark: SparkSession, path: str) -> DataFrame:
    """A table, be it a folder or a single file, as a stream of its files."""
    folder, _, name = path.rpartition("/")
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{folder}/[{name[0]}]{name[1:]}")  # a pattern may name a file


def tumbling_counts(events: DataFrame, width: str, late: str) -> DataFrame:
    """(window_start, event_type, n, total) of time windows; events later than ``late`` after their window are left out."""
    at = events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)
    counts = at.groupBy(F.window("at", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum(F.rint(F.col("value") * 100).cast("long")).alias("total"))
    return counts.select(F.col("w.start").alias("window_start"), "event_type", "n", "total")


def run_to_table(stream: DataFrame, table: str, checkpoint: str) -> DataFrame:
    """All that the source holds now, through the stream; the finished result is read back."""
    def keep(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").parquet(table)

    query = stream.writeStream.outputMode("complete").option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(keep).start()
    query.awaitTermination()
    return stream.sparkSession.read.parquet(table)
