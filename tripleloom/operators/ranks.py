"""Ranks and running sums of tables of any size, without a window over all rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .components import checkpointed


def numbered(df: DataFrame, order: list[Column | str], by: list[str] | None = None, value: Column | None = None) -> DataFrame:
    """``df`` with ``rank``, each row's place (from 1) in its group, and with ``value`` also ``before``, the sum over the rows ahead of it.

    Rows are sorted by range, so a group may span many partitions; each partition
    ranks its own rows, and what lies in the partitions ahead is added from a table with a row per
    partition and group.  Ties take any order, the same for every reader.
    """
    by = by or []
    x = df.withColumn("_rk_v", (F.lit(0.0) if value is None else value).cast("double"))
    x = checkpointed(x.orderBy(*by, *order).withColumn("_rk_p", F.spark_partition_id()))
    per = x.groupBy("_rk_p", *by).agg(F.count(F.lit(1)).alias("_rk_n"), F.sum("_rk_v").alias("_rk_s"))
    ahead = Window.partitionBy(*by).orderBy("_rk_p").rowsBetween(Window.unboundedPreceding, -1)  # a row per partition of the group
    zero = lambda c: F.coalesce(c, F.lit(0))
    per = per.select(F.col("_rk_p").alias("_rk_q"), *(F.col(c).alias(f"_by{i}") for i, c in enumerate(by)), zero(F.sum("_rk_n").over(ahead)).alias("_rk_n"), zero(F.sum("_rk_s").over(ahead)).alias("_rk_s"))
    same = reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"_by{i}")) for i, c in enumerate(by)), F.col("_rk_p") == F.col("_rk_q"))
    own = Window.partitionBy("_rk_p", *by).orderBy(*order)
    x = x.withColumn("_rk_r", F.row_number().over(own))
    if value is not None:
        x = x.withColumn("_rk_b", zero(F.sum("_rk_v").over(own.rowsBetween(Window.unboundedPreceding, -1))))
    x = x.join(per, same).withColumn("rank", F.col("_rk_r") + F.col("_rk_n"))
    out = x if value is None else x.withColumn("before", F.col("_rk_b") + F.col("_rk_s"))
    return out.select(*df.columns, "rank", *(["before"] if value is not None else []))
