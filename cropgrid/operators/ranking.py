"""Places of rows in an order, however large a group is.

Rows are sorted once over all tasks by group and order and kept as a table; a row's place is its place in the part of
its group that its task holds, plus the rows of earlier tasks. No group passes through one task as it would in a window, and
the running sum over tasks has a row for each task and group at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cropgrid.session import kept_table

#: Bits below the task number in monotonically_increasing_id.
TASK_SHIFT = 33


def ranked(rows: DataFrame, group: list[str], order: list[str], name: str = "position") -> DataFrame:
    """``rows`` with the 0-based place of each in its group, by ``order`` ascending and null first.

    Rows equal in group and order stand in any order, so give a whole order where that matters. Empty in, empty out.
    """
    keys = [F.col(c).asc_nulls_first() for c in (*group, *order)]
    placed = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id())
    kept = kept_table(placed, "ranked").withColumn("_task", F.shiftright("_at", TASK_SHIFT))
    parts = kept.groupBy("_task", *group).agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    earlier = Window.partitionBy(*group).orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    shift = (F.coalesce(F.sum("_n").over(earlier), F.lit(0)) - F.col("_first")).alias("_shift")
    before = parts.select(F.col("_task").alias("_of"), *[F.col(c).alias(f"_of_{c}") for c in group], shift)
    equal = F.col("_task") == F.col("_of")
    for c in group:
        equal = equal & F.col(c).eqNullSafe(F.col(f"_of_{c}"))
    return kept.join(before, equal).select(*rows.columns, (F.col("_at") + F.col("_shift")).alias(name))
