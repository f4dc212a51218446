"""The shared folder of a cluster, and plans that are cut there."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. Unset, it is a temporary folder in local mode, and an error on a cluster."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if sc.getCheckpointDir() is None:
        if not named and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="lectern-checkpoint-"))
    return named or sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """df, written to the shared folder: later plans start from there, however often they read it."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def numbered(df: DataFrame, name: str, *order: Column) -> DataFrame:
    """df with a number from 1 in the given total order, in a column of this name.

    The table is divided by ranges and cut there; only a count a range meets in one place, so no task holds more
    than one range.
    """
    # df is cut first: the ranges come from a sample, and the order may hang on values that a second reading finds anew.
    ranges = cut(cut(df).repartitionByRange(*order).withColumn(_RANGE, F.spark_partition_id()))
    counts = ranges.groupBy(_RANGE).agg(F.count("*").alias(_COUNT))
    before = Window.orderBy(_RANGE).rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    counts = counts.select(_RANGE, F.coalesce(F.sum(_COUNT).over(before), F.lit(0)).alias(_COUNT))
    own = F.row_number().over(Window.partitionBy(_RANGE).orderBy(*order))
    return ranges.join(F.broadcast(counts), _RANGE).withColumn(name, own + F.col(_COUNT)).drop(_RANGE, _COUNT)


_RANGE, _COUNT = "__lectern_range", "__lectern_before"
