"""Stateful behaviours over event streams: de-duplication, debouncing, retries, circuit breaking.

Each function turns a streaming (or batch) DataFrame of events into another; the queries run them over the
events table as a stream that ends when all of it is read.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.plans.folders import new_folder
from corvane.plans.registry import query

# The time to live of marks, the breaker's limit and pause.
TTL, FAILURES, PAUSE_S = "7 days", 10, 60


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a stream, with an event time that a watermark accepts."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir).withColumn("at", F.col("ts").cast("timestamp"))


def drained(stream: DataFrame, tag: str, mode: str = "append") -> DataFrame:
    """Run a stream over all that is there, into a table of the shared folder; state and progress are kept beside it."""
    spark = stream.sparkSession
    place = new_folder(spark, tag)
    run = stream.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", f"{place}/progress").option("path", f"{place}/rows").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{place}/rows")


def marked_once(events: DataFrame, ttl: str = TTL) -> DataFrame:
    """The first mark of each key; repeats within the time to live are dropped."""
    return events.withWatermark("at", ttl).dropDuplicatesWithinWatermark(["user_id", "event_type"])


def debounced(events: DataFrame, gap: str = "5 seconds", late: str = "10 seconds") -> DataFrame:
    """(user_id, started, n): updates flush together once none has come for a while."""
    return events.withWatermark("at", late).groupBy("user_id", F.session_window("at", gap).alias("w")).agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("started"), "n")


def counted(events: DataFrame, window: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """(event_type, since, n): counts of closed windows."""
    return events.withWatermark("at", late).groupBy("event_type", F.window("at", window).alias("w")).agg(F.count("*").alias("n")).select("event_type", F.col("w.start").alias("since"), "n")


def breaker(events: DataFrame, failures: int = FAILURES, pause_s: int = PAUSE_S) -> DataFrame:
    """(user_id, event_id, state): the circuit's state when each event comes.

    After so many failures in a row the circuit is open; after the pause one attempt is let through
    (half open), which closes it or opens it anew. State is a counter and a time for each user. The events of a
    user within one trigger are put in order of time, so triggers should be bounded (maxFilesPerTrigger).
    """

    def step(key, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        count, opened = state.get if state.exists else (0, 0.0)
        # a trigger's events of a user come in several batches without order
        b = pd.concat(list(batches)).sort_values(["at", "event_id"])
        out = []
        for kind, at in zip(b["event_type"], b["at"].astype("int64") / 1e9, strict=True):
            now = "closed" if count < failures else "half_open" if at - opened >= pause_s else "open"
            out.append(now)
            if now != "open":
                count = count + 1 if kind == "error" else 0
                opened = at if count >= failures else opened
        yield pd.DataFrame({"user_id": key[0], "event_id": b["event_id"], "state": out})
        state.update((count, opened))

    return events.groupBy("user_id").applyInPandasWithState(step, "user_id long, event_id long, state string", "count long, opened double", "append", "NoTimeout")


@query("stm_01_stream_dedup")
def stream_dedup(spark, sf_dir) -> DataFrame:
    return drained(marked_once(event_stream(spark, sf_dir)).select("event_id", "user_id", "event_type"), "marks")


@query("stm_08_stream_debounce")
def stream_debounce(spark, sf_dir) -> DataFrame:
    return drained(debounced(event_stream(spark, sf_dir), "1 hour"), "debounce")


@query("stm_02_windowed_counts")
def windowed_counts(spark, sf_dir) -> DataFrame:
    return drained(counted(event_stream(spark, sf_dir)), "counts")


@query("stm_06_circuit_breaker")
def circuit_breaker(spark, sf_dir) -> DataFrame:
    return drained(breaker(event_stream(spark, sf_dir)), "breaker")
