"""Running sums and neighbours in one order over a whole table, without a window over all of it.

Rows are ranged by the order into parts and written once, so a row's part is a fact and not the
outcome of a plan that may be drawn up anew. Windows run inside a part; between the parts goes one
row for each of them, which is as many rows as there are partitions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leafmill.sources.scratch import cut_lineage


def in_parts(frame: DataFrame, order: list[str]) -> DataFrame:
    """Adds __part, rising with the order; equal orders share a part."""
    return cut_lineage(frame.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()))


def running_sum(parted: DataFrame, order: list[str], value: str, name: str, inclusive: bool = True) -> DataFrame:
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    base = parted.groupBy("__part").agg(F.sum(value).alias("__n")).withColumn("__base", F.coalesce(F.sum("__n").over(before), F.lit(0))).select("__part", "__base")
    inner = Window.partitionBy("__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    return parted.withColumn("__inner", F.coalesce(F.sum(value).over(inner), F.lit(0))).join(F.broadcast(base), "__part").withColumn(name, F.col("__base") + F.col("__inner")).drop("__base", "__inner")


def value_before(parted: DataFrame, order: list[str], value: str, name: str) -> DataFrame:
    """Adds the value of the row before in the order; null in the first row. Values must not be null."""
    tails = parted.groupBy("__part").agg(F.max_by(value, F.struct(*order)).alias("__tail"))
    tails = tails.select(F.lead("__part").over(Window.orderBy("__part")).alias("__part"), "__tail").filter("__part IS NOT NULL")
    inner = Window.partitionBy("__part").orderBy(*order)
    return parted.withColumn("__lag", F.lag(value).over(inner)).join(F.broadcast(tails), "__part", "left").withColumn(name, F.coalesce("__lag", "__tail")).drop("__lag", "__tail")
