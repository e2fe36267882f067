"""Numbers of rows inside their groups from one distributed sort, where a window would bring a whole group into one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fernlog.storage import small, stored

#: Groups whose starts may be broadcast.
BROADCAST_GROUPS = 100_000


def numbered(df: DataFrame, by: list[str], order: list[Column | str], name: str = "number") -> DataFrame:
    """``df`` with ``name``, the number (from 1) of each row among those with the same ``by`` (never null) in ``order``.

    All rows are sorted into ranges, which may begin and end inside a group, and stored with their place in their range. Sums over the
    ranges before (a row a range) give a place among all, and a group's least place (a row a group) the number. So no task
    holds a group, however large it is. Rows that ``order`` doesn't tell apart are numbered in any order.
    """
    placed = df.orderBy(*by, *order).withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id()})
    placed = stored(placed, "numbered")
    sizes = placed.groupBy("_part").agg(F.count("*").alias("n"), F.min("_at").alias("_first"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shifts = F.broadcast(sizes.select("_part", (before - F.col("_first")).alias("_shift")))
    placed = placed.join(shifts, "_part").withColumn("_place", F.col("_at") + F.col("_shift"))
    starts = placed.groupBy(*by).agg(F.min("_place").alias("_start"))
    out = placed.join(small(starts, BROADCAST_GROUPS), by)
    return out.select(*[f"`{c}`" for c in df.columns], (F.col("_place") - F.col("_start") + 1).alias(name))
