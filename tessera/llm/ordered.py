"""Dense row numbers inside groups, without one task for a group."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

#: ``monotonically_increasing_id`` counts rows in its low bits, partitions above them.
PART_BIT = 33
#: Rows of the table of run starts up to which it is broadcast; it has one for each partition and group.
BROADCAST_RUNS = 100_000


def numbered(df: DataFrame, group: str, order: list[str], name: str) -> tuple[DataFrame, DataFrame]:
    """``df`` with ``idx``, from 0 inside its ``group`` by ``order``, and ``n``, the group's rows; and
    the groups' sizes (``group``, ``n``).

    Rows are sorted by ranges of group and order together, so a group of very many rows lies in very
    many partitions; each partition's run of a group starts where those before it end.  ``group`` is
    never null.  The sorted rows are written, so numbers stay the same if a task is run again."""
    at, part, first, start, end = "__at", "__part", "__first", "__start", "__end"
    placed = df.repartitionByRange(group, *order).sortWithinPartitions(group, *order).withColumn(at, F.monotonically_increasing_id())
    placed = cut(placed, f"{name}-sorted", "zstd")
    of = F.shiftright(at, PART_BIT)
    runs = placed.groupBy(group, of.alias(part)).agg(F.min(at).alias(first), F.count(F.lit(1)).alias("__rows"))
    before = Window.partitionBy(group).orderBy(part)
    runs = runs.withColumn(end, F.sum("__rows").over(before.rowsBetween(Window.unboundedPreceding, 0)))
    runs = cut(runs.select(group, part, first, (F.col(end) - F.col("__rows")).alias(start), end), f"{name}-runs")
    sizes = runs.groupBy(group).agg(F.max(end).alias("n"))
    starts = runs.join(sizes, group).select(group, part, first, start, "n")
    if runs.count() <= BROADCAST_RUNS:
        starts = F.broadcast(starts)
    out = placed.withColumn(part, of).join(starts, [group, part]).withColumn("idx", F.col(at) - F.col(first) + F.col(start))
    return out.drop(at, part, first, start), sizes
