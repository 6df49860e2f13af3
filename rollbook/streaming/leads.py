"""Streams of leads: first-seen intake, cooldowns of hosts, counters by day."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.files import scratch


def stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table's files as a stream. The path is a pattern, as one file alone can't be the base path of a stream."""
    path = f"{sf_dir}/{name}.parquet"
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{path}*")


def drained(df: DataFrame, mode: str = "append") -> DataFrame:
    """What the stream gives for all that is there now, read back from the shared folder. In update mode there is a row for
    each time that a key changed, with the number of its batch; a batch that is run again after a failure replaces what
    it wrote."""
    spark = df.sparkSession
    out, state = scratch(spark, "stream"), scratch(spark, "state")
    writer = df.writeStream.outputMode(mode).option("checkpointLocation", state).trigger(availableNow=True)
    if mode == "append":
        query = writer.format("parquet").option("path", out).start()
    else:

        def put(batch: DataFrame, number: int) -> None:
            batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

        query = writer.foreachBatch(put).start()
    query.awaitTermination()
    if mode == "append":
        return spark.read.schema(df.schema).parquet(out)
    return spark.read.schema(df.withColumn("batch", F.lit(0)).schema).parquet(out)


def first_seen(leads: DataFrame, key: str, time: str, delay: str) -> DataFrame:
    """One lead of each key within the watermark."""
    return leads.withWatermark(time, delay).dropDuplicatesWithinWatermark([key])


def cooldowns(failures: DataFrame, host: str, time: str, seconds: str, delay: str = "1 day") -> DataFrame:
    """(day, host, until): the time until which each host is left alone, by failures of one day: the greatest of failure
    time + seconds. Run it in update mode; a day's state ends with the watermark."""
    rows = failures.withWatermark(time, delay).select(time, F.col(host).cast("string").alias("host"), (F.unix_seconds(F.col(time)) + F.col(seconds)).cast("long").alias("at"))
    return rows.groupBy(F.window(time, "1 day").alias("day"), "host").agg(F.max("at").alias("until")).select(F.col("day.start").alias("day"), "host", "until")


def deferred(leads: DataFrame, held: DataFrame, host: str, time: str) -> DataFrame:
    """leads with deferred: whether their host is still left alone at their time. held: host, until (any number of rows)."""
    until = held.groupBy("host").agg(F.max("until").alias("until"))
    rows = leads.withColumn("host", F.col(host).cast("string")).join(until, "host", "left")
    return rows.withColumn("deferred", F.coalesce(F.unix_seconds(F.col(time)) < F.col("until"), F.lit(False))).drop("until")


#: States of leads whose host may just have been throttled, and the state of those that wait.
THROTTLED, DEFERRED = ("unavailable:ValueError", "unavailable:HTTP429"), "deferred_host_backoff"


def recovered(leads: DataFrame, batches: DataFrame) -> DataFrame:
    """A stream of leads (host, status, verified_on) in which those that were found unavailable in the batch that a host was
    throttled in (host, batch: a table) wait again; all others are as they were."""
    joined = leads.join(batches, "host", "left")
    again = F.col("status").isin(*THROTTLED) & (F.col("verified_on") == F.col("batch"))
    return joined.withColumn("status", F.when(again, DEFERRED).otherwise(F.col("status"))).drop("batch")


def daily_counts(events: DataFrame, time: str, kind: str, delay: str) -> DataFrame:
    day = F.window(time, "1 day")
    return events.withWatermark(time, delay).groupBy(day.alias("day"), kind).agg(F.count(F.lit(1)).alias("n")).select(F.col("day.start").alias("day"), kind, "n")
