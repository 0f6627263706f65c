"""Shared storage: written tables that cut lineage, and plain files that executors write and read by URI."""

from __future__ import annotations

import atexit
import posixpath
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; where that is unset, in local mode only (tests), one temporary folder of this process."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    if "dir" not in _own:
        _own["dir"] = tempfile.mkdtemp(prefix="glossweave-")
        atexit.register(shutil.rmtree, _own["dir"], ignore_errors=True)
    return "file://" + _own["dir"]


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: later plans start from the files, whatever executors are lost."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a path of the shared folder through Hadoop's file system."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def drop(df: DataFrame) -> None:
    """Delete the files of a table made by materialise() once nothing reads it any more."""
    for f in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        remove(df.sparkSession, f)


def file_system(uri: str):
    """(pyarrow file system, path) of a URI; a bare path is local."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri else "file://" + uri)


def write_file(uri: str, parts) -> int:
    """Write the byte strings of `parts` to a file that appears whole or not at all; returns its size.

    The name belongs to one partition, and a second attempt of its task writes the same bytes, so the last rename wins."""
    system, path = file_system(uri)
    system.create_dir(posixpath.dirname(path), recursive=True)
    hidden, size = posixpath.join(posixpath.dirname(path), f".{uuid.uuid4().hex}"), 0
    with system.open_output_stream(hidden, compression=None) as out:
        for part in parts:
            out.write(part)
            size += len(part)
    system.move(hidden, path)
    return size


def read_range(uri: str, start: int = 0, length: int | None = None) -> bytes:
    system, path = file_system(uri)
    with system.open_input_file(path) as f:
        f.seek(start)
        return f.read(length) if length is not None else f.read()
