"""Points as a stream: cells are stateless expressions, so they run in Structured Streaming as they are."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilewright.functions import cells


def with_cells(points: DataFrame, zoom: int, lon: str = "lon", lat: str = "lat") -> DataFrame:
    """A stream or table of points with their cells."""
    return points.withColumn("block", cells.from_lonlat(F.col(lon), F.col(lat), F.lit(zoom)))


def counts_by_cell(points: DataFrame, zoom: int, time: str, every: str, late: str, lon: str = "lon", lat: str = "lat") -> DataFrame:
    """Points by cell and time window; points later than ``late`` are left out, and closed windows leave the state."""
    located = with_cells(points, zoom, lon, lat).withWatermark(time, late)
    return located.groupBy(F.window(time, every).alias("window"), "block").agg(F.count(F.lit(1)).alias("points"))
