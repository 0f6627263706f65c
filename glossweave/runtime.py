"""What every distributed Python function of this package needs: the package itself on the executors."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import shutil
import tempfile
from collections.abc import Callable, Iterator
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()
#: Rows of an Arrow batch: with long texts the default of 10,000 fills a Python worker with copies of one batch.
BATCH_ROWS = 1000


def ship(spark: SparkSession) -> None:
    """Send this package's source to the executors, once an application, so that functions pickled by name are found there.

    Also bounds the Arrow batches of a session that has left their size at its default."""
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    package = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="glossweave-src-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    plain = Path(folder, "src", package.name)
    shutil.copytree(package, plain, ignore=shutil.ignore_patterns("__pycache__"))
    spark.sparkContext.addPyFile(shutil.make_archive(f"{folder}/{package.name}", "zip", plain.parent, package.name))
    _shipped.add(app)


def give_back() -> None:
    """Return freed memory to the system: Python workers are kept for later tasks and would hold what one task needed at most."""
    import pyarrow

    pyarrow.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # another C library
        ctypes.CDLL(None).malloc_trim(0)


def map_arrow(df: DataFrame, function: Callable, schema: str) -> DataFrame:
    """df.mapInArrow with the package shipped, and memory given back after each task."""
    ship(df.sparkSession)

    def run(batches: Iterator) -> Iterator:
        try:
            yield from function(batches)
        finally:
            give_back()

    return df.mapInArrow(run, schema)
