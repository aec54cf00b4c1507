"""Learning events as a stream: validation, dedup, daily roll-up and keyed sinks.

Late events are counted for seven days (the validation window), unlike a job
that runs once for the day before: a deliberate difference.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import numerics as N
from ..sources.store import staged

EVENT_TYPES = ("session_started", "answer_submitted", "session_ended")


def acceptable(client_ts: Column, now: Column) -> Column:
    """At most seven days old and at most thirty seconds ahead."""
    return client_ts.between(now - F.expr("interval 7 days"), now + F.expr("interval 30 seconds"))


def deduplicated(events: DataFrame, key: str = "event_id", delay: str = "30 seconds") -> DataFrame:
    """Each key once within the delay."""
    return events.withWatermark("client_ts", delay).dropDuplicatesWithinWatermark([key])


def daily_windows(events: DataFrame) -> DataFrame:
    """The daily roll-up over event time.  Exact distinct counts do not stream; a set of sessions has a bound, a student's day."""
    answer = F.col("event_type") == "answer_submitted"
    given = F.schema_of_variant(F.try_variant_get(F.try_parse_json("payload"), "$.isCorrect", "variant"))
    duration = N.json_number(F.col("payload"), "$.durationMs")
    grouped = events.withWatermark("client_ts", "7 days").groupBy(F.window("client_ts", "1 day"), "student_id")
    counted = grouped.agg(
        F.count_if(F.col("event_type") == "session_started").alias("viewed"),
        F.count_if(answer & (given != "VOID")).alias("solved"),
        F.count_if(answer & N.json_boolean(F.col("payload"), "$.isCorrect")).alias("correct"),
        F.coalesce(F.sum(F.when((F.col("event_type") == "session_ended") & (duration > 0), N.js_round(duration))), F.lit(0)).alias("duration_ms"),
        F.collect_set("session_id").alias("sessions"),
    )
    return counted.select("student_id", F.to_date("window.start").alias("day"), "viewed", "solved", "correct", "duration_ms", F.size("sessions").cast("long").alias("n_sessions"))


def keyed_replacement(keys: list[str]) -> Callable[[DataFrame, DataFrame], DataFrame]:
    return lambda old, new: old.join(new.select(*keys), keys, "left_anti").unionByName(new)


def current(spark: SparkSession, path: str) -> DataFrame:
    """The table kept by upsert_batches."""
    return spark.read.parquet(path).drop("as_of")


def upsert_batches(path: str, part: str, merge: Callable[[DataFrame, DataFrame], DataFrame]) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that merges each batch into a table partitioned by part.

    Only the partitions that a batch touches are read and written: merged aside first, then put in place of
    the old ones.  Each has the number of its last batch (as_of), so a batch that is run again leaves those
    alone that it had reached.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        batch = batch.withColumn("as_of", F.lit(number).cast("long")).persist()
        into = lambda df, mode: df.write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy(part).parquet(path)
        into(batch.limit(0), "append")  # the table is there from the first batch on
        table = spark.read.schema(batch.schema).parquet(path)
        old = table.join(F.broadcast(batch.select(part).distinct()), part, "left_semi").select(*batch.columns)  # one row for each value of part
        had = old.groupBy(part).agg(F.max("as_of").alias("as_of")).where(F.col("as_of") >= number)
        fresh = batch.join(F.broadcast(had), part, "left_anti").drop("as_of")
        kept = old.join(F.broadcast(had), part, "left_anti").drop("as_of")
        into(staged(merge(kept, fresh).withColumn("as_of", F.lit(number).cast("long")), "merged"), "overwrite")
        batch.unpersist()

    return write
