"""Replay of recorded lines: when each line is due."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def schedule(lines: DataFrame, speed: float = 1.0, max_gap_s: float = 60.0, by: list[str] | None = None) -> DataFrame:
    """Adds offset_s, backwards and skipped_s to rows with seq and t (null: untimed).

    A line is due (latest time so far - first - skipped) / speed after the start, where the excess of gaps beyond
    max_gap_s is skipped. Time never goes back; an untimed line is due with the line before it. `by` separates
    recordings, whose schedules are made in parallel.
    """
    by = by or []
    order = Window.partitionBy(*by).orderBy("seq")
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    latest, first = F.max("t").over(so_far), F.first("t", ignorenulls=True).over(so_far)
    step = lines.withColumns({"latest": latest, "first": first})
    step = step.withColumn("before", F.lag("latest").over(order))
    gap = F.coalesce(F.col("latest") - F.col("before"), F.lit(0.0))
    step = step.withColumn("excess", F.greatest(gap - max_gap_s, F.lit(0.0)))
    step = step.withColumn("skipped_s", F.sum("excess").over(so_far))
    due = F.lit(0.0) if speed <= 0 else (F.col("latest") - F.col("first") - F.col("skipped_s")) / speed
    backwards = F.coalesce(F.col("t") < F.col("before"), F.lit(False))
    return step.select(*lines.columns, F.coalesce(due, F.lit(0.0)).alias("offset_s"), backwards.alias("backwards"), "skipped_s")
