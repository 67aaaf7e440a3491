"""Streaming over events: windowed counts, sessions, and edges merged as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def read_stream(spark: SparkSession, folder: str, schema: str = EVENTS, files: int = 16) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(folder)


def windowed(events: DataFrame, length: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """(window_start, event_type, n, total); events later than the watermark are dropped by the engine."""
    g = events.withWatermark("ts", late).groupBy(F.window("ts", length).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return g.select(F.col("w.start").alias("window_start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """(user_id, session_start, session_end, n) of runs of events no further apart than the gap."""
    e = events.withWatermark("ts", late) if events.isStreaming else events
    g = e.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"))
    return g.select("user_id", F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")


BUCKETS = 256


def merge_into(path: str, keys: list[str], merge):
    """A foreachBatch function: a batch of witnesses is added to those at ``path`` once (by batch id), and the facts of the buckets of keys it touches are merged anew.

    Witnesses and ``path``-facts are partitioned by a hash of the key, so the cost of a batch follows the
    buckets it touches, and readers of other buckets see no change. A batch that is run again replaces its
    own witnesses. ``read_facts`` reads the facts.
    """

    def add(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        own = batch.withColumn("_bucket", F.pmod(F.xxhash64(*keys), F.lit(BUCKETS)).cast("int"))
        own.write.mode("overwrite").partitionBy("_bucket").parquet(f"{path}/witnesses/_batch={batch_id}")
        touched = [r[0] for r in own.select("_bucket").distinct().collect()]  # at most BUCKETS
        if not touched:
            return
        all_of = spark.read.option("basePath", f"{path}/witnesses").parquet(f"{path}/witnesses").where(F.col("_bucket").isin(touched)).drop("_batch", "_bucket")
        facts = merge(all_of, keys).withColumn("_bucket", F.pmod(F.xxhash64(*keys), F.lit(BUCKETS)).cast("int"))
        facts.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("_bucket").parquet(f"{path}-facts")

    return add


def read_facts(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}-facts").drop("_bucket")
