"""Written intermediate tables: they cut lineage and survive lost executors, where a persisted plan would not."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_own: dict[str, str] = {}


def work_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which executors share; a temporary one of this process where it is unset, in local mode only."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    if "dir" not in _own:
        _own["dir"] = tempfile.mkdtemp(prefix="glossweave-work-")
        atexit.register(shutil.rmtree, _own["dir"], ignore_errors=True)
    return "file://" + _own["dir"]


def written(df: DataFrame, name: str) -> DataFrame:
    path = f"{work_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def in_order(order: Column, value: Column) -> Column:
    """Aggregate: the values of a group as an array, by `order`."""
    return F.transform(F.array_sort(F.collect_list(F.struct(order.alias("o"), value.alias("v")))), lambda x: x["v"])


def numbered(df: DataFrame, group: list[Column | str], order: list[Column | str], name: str) -> DataFrame:
    """df with `name`: 0, 1, ... inside each group, in order. The groups' columns must be among df's or made from them.

    Rows are dealt by range, numbered where they lie, and shifted by the counts of the ranges before, so a group isn't one task's."""
    keys = [f"__group{i}" for i in range(len(group))]
    made = df.select("*", *[(F.col(g) if isinstance(g, str) else g).alias(k) for g, k in zip(group, keys, strict=True)])
    by = [*keys, *order]
    placed = written(made.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("__at", F.monotonically_increasing_id()), "numbered")
    part = F.shiftright("__at", 33).alias("__part")
    runs = placed.groupBy(*keys, part).agg(F.min("__at").alias("__first"), F.count("*").alias("__n"))
    before = F.sum("__n").over(Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    runs = runs.withColumn("__before", F.coalesce(before, F.lit(0))).drop("__n")
    back = placed.withColumn("__part", part).join(runs, [*keys, "__part"])
    return back.withColumn(name, (F.col("__before") + F.col("__at") - F.col("__first")).cast("long")).select(*df.columns, name)
