"""Geometries burnt into cells: values add up or replace one another, over any number of geometries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilewright.errors import GeometryError
from tilewright.functions import geometry


def burn(geometries: DataFrame, zoom: int, value: str, order: str | None = None, merge: str = "replace", wkt: str = "wkt", cover: bool = False) -> DataFrame:
    """(block, value): a row for each cell that some geometry covers.

    ``merge``: of several values the one of the greatest ``order`` stays (``replace``), or their sum (``add``). Each geometry
    counts once in a cell. Values are merged where the geometries are, before anything shuffles.
    """
    cells = geometries.select(F.explode(geometry.polyfill(wkt, F.lit(zoom), cover)).alias("block"), F.col(value).alias("value"), F.col(order or value).alias("order"))
    if merge == "add":
        return cells.groupBy("block").agg(F.sum("value").alias("value"))
    if merge == "replace":
        return cells.groupBy("block").agg(F.max(F.struct("order", "value")).alias("last")).select("block", F.col("last.value").alias("value"))
    raise GeometryError(f"unknown merge {merge!r}")
