"""Reading inputs and cutting lineage with tables in the shared folder."""

from __future__ import annotations

import contextlib
import re
import tempfile
import uuid
from collections.abc import Iterator
from urllib.parse import unquote

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession


def open_shared(uri: str) -> pa.NativeFile:
    """A file of a shared folder for reading at any place in a task: a local or mounted path, or a store that Arrow knows (HDFS, S3, GCS, Azure)."""
    scheme, found, rest = uri.partition(":")
    if not found or scheme == "file":
        return pyarrow.fs.LocalFileSystem().open_input_file(re.sub("^/+", "/", unquote(rest) if found else uri))
    system, path = pyarrow.fs.FileSystem.from_uri(re.sub("^s3[an]:", "s3:", uri))
    return system.open_input_file(path)


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; a session in one process (tests) that has none gets a temporary one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="gaugeleaf-"))
    return context.getCheckpointDir()


#: Folders written by materialize and not released.
_WRITTEN: list[str] = []


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def write_table(df: DataFrame, name: str, *partition_by: str, path: str | None = None) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back: no recomputation, short lineage."""
    path = path or fresh_path(df.sparkSession, name)
    writer = df.write
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def materialize(df: DataFrame, name: str, *partition_by: str) -> DataFrame:
    """write_table for an intermediate result, which released_after may delete."""
    path = fresh_path(df.sparkSession, name)
    _WRITTEN.append(path)
    return write_table(df, name, *partition_by, path=path)


@contextlib.contextmanager
def released_after(spark: SparkSession) -> Iterator[None]:
    """Deletes, at the end, what materialize has written inside: for steps whose result is written elsewhere by then."""
    begin = len(_WRITTEN)
    yield
    gone, _WRITTEN[begin:] = _WRITTEN[begin:], []
    for path in gone:
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
