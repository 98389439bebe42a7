"""Dense numbers in a global order without a single-partition window."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import materialize


def with_dense_ids(df: DataFrame, order: list[str], name: str, start: int = 1) -> DataFrame:
    """``df`` with a column of consecutive numbers in the order of ``order``, which must order the rows totally.

    Rows are range-partitioned; a range's first number is the count of rows in the ranges before it, of which there
    are as many as partitions.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = materialize(df.repartitionByRange(n, *order).withColumn("__range", F.spark_partition_id()), "ranges")
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    bases = ranged.groupBy("__range").agg(F.count("*").alias("__n")).withColumn("__base", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n")
    numbered = ranged.withColumn("__row", F.row_number().over(Window.partitionBy("__range").orderBy(*order)))
    return numbered.join(F.broadcast(bases), "__range").withColumn(name, (F.col("__base") + F.col("__row") - 1 + start).cast("long")).drop("__range", "__base", "__row")
