"""Global ranks and first-k selections that no single task holds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from terrane.operators.graphs import cut


def ranked(df: DataFrame, *order: Column | str, name: str = "rank") -> DataFrame:
    """df with the zero-based place of each row in the order, which must leave no ties.

    Rows are dealt to range partitions and written, so that both uses see the
    same partitions; sizes of partitions are summed, and rows are counted inside them."""
    order = tuple(F.col(o) if isinstance(o, str) else o for o in order)
    held = cut(df.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()))
    sizes = held.groupBy("__part").agg(F.count("*").alias("__n"))
    # one row for each partition
    before = sizes.select("__part", F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    place = F.row_number().over(Window.partitionBy("__part").orderBy(*order)) - 1 + F.col("__before")
    return held.join(F.broadcast(before), "__part").withColumn(name, place).drop("__part", "__before")


def kth(df: DataFrame, k: int, *order: str) -> Row | None:
    """The values of the order's columns, which must leave no ties, in the row at zero-based place k; None if there is none."""
    return ranked(df.select(*order), *order, name="__at").where(F.col("__at") == k).drop("__at").first()


def first(df: DataFrame, k: int, *order: str) -> DataFrame:
    """The k first rows of the rising order of columns, as a set. Only the order's columns are written and
    dealt to ranges: they give the last of the k rows, and a filter keeps the rows of df up to it."""
    last = kth(df, k - 1, *order) if k > 0 else None
    if last is None:
        return df.where("false") if k <= 0 else df
    bound = F.struct(*(F.lit(last[o]).cast(df.schema[o].dataType).alias(o) for o in order))
    return df.where(F.struct(*order) <= bound)


def running(df: DataFrame, group: list[str], order: list[str], sums: list[str], place: str = "step", prefix: str = "g_") -> DataFrame:
    """df with the one-based place of each row in its group and the sums of columns up to it, the row itself
    included; order must leave no ties in a group.

    Rows are dealt to ranges of group and order, so a group of any size is in several; sums inside a
    range start from those of the group's earlier ranges, of which there is one row each."""
    held = cut(df.repartitionByRange(*group, *order).withColumn("__part", F.spark_partition_id()))
    totals = held.groupBy("__part", *group).agg(F.count("*").alias("__n"), *(F.sum(c).alias(f"__{c}") for c in sums))
    before = Window.partitionBy(*group).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    start = lambda c, zero: F.coalesce(F.sum(c).over(before), F.lit(zero))
    earlier = totals.select("__part", *group, start("__n", 0).alias("__n"), *(start(f"__{c}", 0.0).alias(f"__{c}") for c in sums))
    inside = Window.partitionBy("__part", *group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rows = held.select("*", F.count("*").over(inside).alias("__at"), *(F.sum(c).over(inside).alias(f"__in_{c}") for c in sums)).join(earlier, ["__part", *group])
    return rows.select(*df.columns, (F.col("__at") + F.col("__n")).alias(place), *((F.col(f"__in_{c}") + F.col(f"__{c}")).alias(f"{prefix}{c}") for c in sums))
