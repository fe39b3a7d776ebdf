"""The last value of a burst of changes, once it has been quiet for a while."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelspark.operators.runs import SETTLE_SECONDS


def settled_stream(changes: DataFrame, gap_seconds: float = SETTLE_SECONDS, late: str = "10 seconds") -> DataFrame:
    """One row per burst of a streaming (key, ts, value): its last value and when it came.

    Bursts are session windows; a burst is emitted when the watermark (``late``)
    has passed its end. ``operators.runs.applied_changes`` then drops values
    equal to the one applied before.
    """
    gap = f"{int(round(gap_seconds * 1000))} milliseconds"
    order = F.struct("ts", "seq") if "seq" in changes.columns else F.struct("ts")
    bursts = changes.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "key").agg(
        F.max_by(F.struct("ts", F.bround(F.col("value").cast("double"), 1).alias("value")), order).alias("last"))
    return bursts.select("key", "last.ts", "last.value")
