"""Ingestion events, in batch and as streams. An event has event_id, ts, user_id, event_type, value and props (JSON)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string"


def normalized(events: DataFrame) -> DataFrame:
    """Adds progress (0 to 100), k from the payload and stage; a missing type is `progress`. Works on streams."""
    kind = F.coalesce(F.nullif(F.trim("event_type"), F.lit("")), F.lit("progress"))
    payload = F.from_json("props", "k bigint")
    return events.withColumn("event_type", kind).withColumn("progress", F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.coalesce("value", F.lit(0.0))))).withColumn("k", payload["k"])


def type_counts(events: DataFrame) -> DataFrame:
    return events.groupBy("event_type").agg(F.count("*").alias("events"), F.min("event_id").alias("first_event"), F.max("event_id").alias("last_event"), F.count_if(F.col("event_type").contains("error")).alias("failures"))


def summary(events: DataFrame) -> DataFrame:
    """One row: counts by type as a map, up to 20 failed events, first and last, whether complete."""
    counts = events.groupBy("event_type").agg(F.count("*").alias("n")).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("event_type", "n")))).alias("by_type"))
    ends = events.agg(F.min_by("event_type", F.struct("ts", "event_id")).alias("first_type"), F.max_by("event_type", F.struct("ts", "event_id")).alias("last_type"))
    failed = events.filter("event_type = 'error'").select("event_id").distinct().orderBy("event_id").limit(20).agg(F.array_sort(F.collect_list("event_id")).alias("failed"))
    return counts.crossJoin(ends).crossJoin(failed)


def last_stage(events: DataFrame) -> DataFrame:
    """The latest event of each source."""
    last = F.max_by(F.struct("event_type", "event_id"), F.struct("ts", "event_id"))
    return events.groupBy("user_id").agg(last.alias("l")).select("user_id", F.col("l.event_type").alias("last_stage"), F.col("l.event_id").alias("last_event"))


def routed(events: DataFrame, accepted: Column) -> tuple[DataFrame, DataFrame]:
    """Events that a handler accepts, and dead letters; what is neither true nor false is one."""
    ok = F.coalesce(accepted, F.lit(False))
    return events.filter(ok), events.filter(~ok)


def tumbling(events: DataFrame, length: str, late: str | None = None) -> DataFrame:
    """start, event_type, n, total for each window. late: watermark, on streams."""
    e = events.withWatermark("ts", late) if late else events
    w = e.groupBy(F.window("ts", length).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return w.select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str, late: str | None = None) -> DataFrame:
    """user_id, start, n of runs of events with less than the gap between them."""
    e = events.withWatermark("ts", late) if late else events
    w = e.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n"))
    return w.select("user_id", F.col("w.start").alias("start"), "n")


def read(spark: SparkSession, path: str, files_at_once: int = 1) -> DataFrame:
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files_at_once).parquet(path)


def publish(events: DataFrame, handlers: dict[str, Callable[[DataFrame], None]], dead: str, checkpoint: str):
    """Starts a stream whose batches go to the handlers by type, "*" to all; events of a failed handler are written to `dead` with its name and error."""

    def batch(rows: DataFrame, number: int) -> None:
        for kind, handler in handlers.items():
            mine = rows if kind == "*" else rows.filter(F.col("event_type") == kind)
            try:
                handler(mine)
            except Exception as e:
                mine.withColumn("handler", F.lit(kind)).withColumn("error", F.lit(str(e)[:500])).withColumn("batch", F.lit(number)).write.mode("append").parquet(dead)

    return events.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
