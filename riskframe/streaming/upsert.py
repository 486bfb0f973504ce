"""Structured Streaming: keeps the latest row per key of arriving result files. An addition; the reports have no streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def latest(rows: DataFrame, key: list[str], version: list[str]) -> DataFrame:
    """The last version of every key; equal versions are settled by the greatest row."""
    rest = [c for c in rows.columns if c not in key and c not in version]
    best = F.max(F.struct(*version, *rest)).alias("_last")
    return rows.groupBy(*key).agg(best).select(*key, *[F.col(f"_last.{c}").alias(c) for c in rows.columns if c not in key])


def upsert_stream(source: DataFrame, key: list[str], version: list[str], state_dir: str, checkpoint: str):
    """A query that merges each micro-batch into a table of latest rows.

    Generations of the table are written side by side and the newest complete one is read; the batch number names a
    generation, so a repeated batch writes the same one again. The one before it is kept for readers, older ones are deleted.
    """
    spark = source.sparkSession

    def merge(batch: DataFrame, epoch: int) -> None:
        before = f"{state_dir}/generation={epoch - 1}"
        path = spark._jvm.org.apache.hadoop.fs.Path(before)
        known = path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)
        rows = spark.read.schema(batch.schema).parquet(before).unionByName(batch) if known else batch
        latest(rows, key, version).select(*batch.columns).write.mode("overwrite").parquet(f"{state_dir}/generation={epoch}")
        old = spark._jvm.org.apache.hadoop.fs.Path(f"{state_dir}/generation={epoch - 2}")
        old.getFileSystem(spark._jsc.hadoopConfiguration()).delete(old, True)

    return source.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True)


def risk_windows(events: DataFrame, *, at: str = "ts", delay: str = "10 minutes", width: str = "5 minutes") -> DataFrame:
    """Counts and sums of values per event type and time window, for late rows up to the delay."""
    return events.withWatermark(at, delay).groupBy(F.window(at, width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("value"))
