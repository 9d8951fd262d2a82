"""Places of rows in a global order, without one task that sorts them all."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keystrata.sources.scratch import materialize


def positions(rows: DataFrame, keys: list[str], within: list[str] | None = None, name: str = "idx") -> DataFrame:
    """``rows`` with ``name``: the place from 0 of each in the order of ``keys``, for each value of ``within``.

    Rows are dealt by ranges of ``within`` and ``keys`` and sorted; a partition's place in its range and the counts of the
    partitions before it add up. One small row for each partition and value meets in a window, no others do.
    """
    within = within or []
    order = [*within, *keys]
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id())
    kept = materialize(ranged.withColumn("_part", F.shiftright("_id", 33)), "ordered")
    counts = kept.groupBy(*within, "_part").agg(F.min("_id").alias("_first"), F.count("*").alias("_n"))
    group = f"partition by {', '.join(within)} " if within else ""
    before = counts.selectExpr(
        *within, "_part", "_first", f"coalesce(sum(_n) over ({group}order by _part rows between unbounded preceding and 1 preceding), 0) as _before"
    )
    placed = kept.join(before, [*within, "_part"])
    return placed.withColumn(name, F.col("_id") - F.col("_first") + F.col("_before")).select(*rows.columns, name)
