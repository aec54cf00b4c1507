"""Tables in the shared folder: stage tables, append-only logs, partition replacement."""

from __future__ import annotations

import re
import tempfile
import uuid
from urllib.parse import unquote

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; a session in one process (tests) that has none gets a temporary one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="gaugeleaf-"))
    return context.getCheckpointDir().rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """df written into the shared folder and read back: computed once, with a short lineage."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def open_shared(uri: str) -> pa.NativeFile:
    """A file of the shared folder for reading in a task: a local or mounted path, or a store that Arrow knows (HDFS, S3, GCS, Azure)."""
    scheme, found, rest = uri.partition(":")
    if not found or scheme == "file":
        return pyarrow.fs.LocalFileSystem().open_input_file(re.sub("^/+", "/", unquote(rest) if found else uri))
    system, path = pyarrow.fs.FileSystem.from_uri(re.sub("^s3[an]:", "s3:", uri))
    return system.open_input_file(path)


def log_source(spark: SparkSession, path: str, schema: T.StructType, files_per_trigger: int = 100) -> DataFrame:
    """A durable log as a stream: its checkpoint gives replay, at least once."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def log_sink(stream: DataFrame, path: str, checkpoint: str):
    """Appends a stream to a log, exactly once for each batch."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def replace_children(children: DataFrame, path: str, parent: str) -> None:
    """The children of the parents in the frame replace what those parents had; other parents keep theirs."""
    children.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(parent).parquet(path)
