"""Content-addressed caches as Parquet tables: rows by a key `k`; only misses are computed."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _table(spark: SparkSession, path: str) -> DataFrame | None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    exists = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)
    return spark.read.parquet(path) if exists else None


def misses(requests: DataFrame, cached: DataFrame | None) -> DataFrame:
    """The requests (k, ...) that the cache lacks."""
    return requests if cached is None else requests.join(cached.select("k"), "k", "left_anti")


def through_cache(requests: DataFrame, path: str, compute: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The result (k, ...) of every request: from the cache, or computed once for equal keys and appended to it.

    compute gets the missing requests and returns k with the result's columns."""
    spark = requests.sparkSession
    missing = misses(requests, _table(spark, path)).dropDuplicates(["k"])
    compute(missing).write.mode("append").parquet(path)
    # two runs at a time may both have computed a key
    cached = _table(spark, path).dropDuplicates(["k"])
    return cached.join(requests.select("k").distinct(), "k", "left_semi")


def definition_key(system: str, provider: str, model: str, prompt: DataFrame) -> DataFrame:
    """prompt (term, prompt) with k."""
    return prompt.withColumn("k", F.sha1(F.concat_ws("\x1f", F.lit(provider), F.lit(model), F.lit(system), "prompt").cast("binary")))
