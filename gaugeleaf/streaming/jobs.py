"""Jobs over event streams: job status, bounded logs and dead letters, counters, running class counts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def fresh_events(events: DataFrame, delay: str = "30 seconds") -> DataFrame:
    """Events without those that came already within the delay; older keys leave the state."""
    return events.withWatermark("at", delay).dropDuplicatesWithinWatermark(["event_id"])


def job_status(events: DataFrame) -> DataFrame:
    """job_id, stage, status and at of the latest event of each job, and n_events: of a table or of one batch of a stream.

    A stream keeps no state for it: batches are merged into a table by merged_status.
    """
    latest = F.max_by(F.struct("stage", "status"), F.struct("at", "event_id"))
    grouped = events.groupBy("job_id").agg(latest.alias("latest"), F.max("at").alias("at"), F.count("*").alias("n_events"))
    return grouped.select("job_id", "latest.stage", "latest.status", "at", "n_events")


def merged_status(old: DataFrame, new: DataFrame) -> DataFrame:
    """Two status tables as one: the later status, and the events of both."""
    latest = F.max_by(F.struct("stage", "status"), "at")
    both = old.unionByName(new).groupBy("job_id").agg(latest.alias("latest"), F.max("at").alias("at"), F.sum("n_events").alias("n_events"))
    return both.select("job_id", "latest.stage", "latest.status", "at", "n_events")


def progress(events: DataFrame, key: str, idle: str = "1 hour") -> DataFrame:
    """key, since and done: finished items in a row of events no further apart than idle; a counter that idles as long is closed and forgotten."""
    counted = events.where("status = 'done'").withWatermark("at", idle).groupBy(key, F.session_window("at", idle).alias("w")).agg(F.count("*").alias("done"))
    return counted.select(key, F.col("w.start").alias("since"), "done")


def lossy_progress(events: DataFrame) -> DataFrame:
    """Progress events only, for a sink that keeps none: whoever is not listening misses them."""
    return events.where("kind = 'progress'").drop("kind")


def class_status(submissions: DataFrame) -> DataFrame:
    """Running counts of each class, for pushes on every submission (output mode update) or whole at every tick (complete)."""
    return submissions.groupBy("class_id").agg(F.count("*").alias("submitted"), F.count_if(F.col("status") == "graded").alias("graded"), F.max("submitted_at").alias("last"))


def bounded_log(path: str, most: int) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that appends each batch to a log as a segment and drops the segments behind the last most rows.

    A segment is named by its batch and its rows, so that a rerun replaces it and dropping needs no read.  The
    log holds its last most rows at least, and less than a segment more: newest() reads it exactly.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        rows = batch.count()
        if rows:
            for _, same, _ in (s for s in segments(batch.sparkSession, path) if s[0] == number):
                drop(batch.sparkSession, same)
            batch.write.mode("overwrite").parquet(f"{path}/segment={number}/rows={rows}")
        batch.unpersist()
        newer = 0
        for _, folder, held in sorted(segments(batch.sparkSession, path), reverse=True):
            if newer >= most:
                drop(batch.sparkSession, folder)
            newer += held

    return write


def segments(spark: SparkSession, path: str) -> list[tuple[int, str, int]]:
    """Number, folder and rows of the finished segments of a bounded log."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/segment=*/rows=*/_SUCCESS")
    found = [f.getPath().getParent() for f in folder.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(folder) or []]
    return [(int(p.getParent().getName().split("=")[1]), p.getParent().toString(), int(p.getName().split("=")[1])) for p in found]


def drop(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def with_dead_letters(good_path: str, bad_path: str, is_good: Column, most: int = 1000, counts_path: str | None = None) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that parts each batch in two: good rows in files named by the batch, so that a rerun replaces them, and a bounded log of the others.

    counts_path, if given, gets a row n for each batch: the others in it, which the log forgets.
    """
    keep_bad = bounded_log(bad_path, most)

    def write(batch: DataFrame, number: int) -> None:
        marked = batch.withColumn("__good", F.coalesce(is_good, F.lit(False))).persist()
        marked.where("__good").drop("__good").write.mode("overwrite").parquet(f"{good_path}/batch={number}")
        others = marked.where("NOT __good").drop("__good")
        if counts_path is not None:
            others.agg(F.count("*").alias("n")).write.mode("overwrite").parquet(f"{counts_path}/batch={number}")
        keep_bad(others, number)
        marked.unpersist()

    return write


def newest(log: DataFrame, order: list[str], most: int) -> DataFrame:
    """What a log of a bounded length still holds: its last rows (1,000 dead letters, some 10,000 events)."""
    return log.orderBy(*(F.desc(c) for c in order)).limit(most)
