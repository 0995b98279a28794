"""Global numbering without a global sort in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tomeflow.core import materialize


def global_number(df: DataFrame, key: Column, out: str, parts: int | None = None) -> DataFrame:
    """Adds ``out``: the row's place from 0 in the order of ``key``. Rows are dealt by
    ranges of the key; each range is numbered by itself and shifted by the counts
    of the ranges before it (one row per range)."""
    parts = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = materialize(df.withColumn("__key", key).repartitionByRange(parts, "__key").withColumn("__part", F.spark_partition_id()), "ranged")
    counts = ranged.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    own = F.row_number().over(Window.partitionBy("__part").orderBy("__key"))
    return ranged.withColumn("__r", own).join(F.broadcast(offsets), "__part").withColumn(out, F.col("__before") + F.col("__r") - 1).drop("__key", "__part", "__before", "__r")
