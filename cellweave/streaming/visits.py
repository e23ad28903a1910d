"""Visit counts over a stream of sightings (an extension of the batch operator)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def streaming_visits(sightings: DataFrame, time: str, event: str, cell: str, late: str = "1 day", window: str = "30 days") -> DataFrame:
    """(window, cell, visits): each event counts once for its cell while it may still arrive late.

    State is bounded by the watermark: events are remembered for `late`, windows
    are given out once it has passed them.
    """
    marked = sightings.withWatermark(time, late)
    once = marked.dropDuplicatesWithinWatermark([event, cell])
    return once.groupBy(F.window(time, window), F.col(cell)).agg(F.count(F.lit(1)).alias("visits"))
