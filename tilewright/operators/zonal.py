"""Statistics over many tiles: merged from per-tile statistics, by zone or by parent cell."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilewright.functions import cells


def merged(stats: Column) -> list[Column]:
    """Aggregates that merge statistics structs into those of all their samples.

    Sums of squares around the means are merged from sums, so partial aggregation works before the shuffle.
    """
    n, mean = stats["valid_count"], stats["mean"]
    total = F.sum(n)
    overall = F.sum(n * mean) / total
    inner = F.sum(F.pow(stats["std_dev"], 2) * (n - 1))
    between = F.sum(n * mean * mean) - F.pow(F.sum(n * mean), 2) / total
    deviation = F.when(total > 1, F.sqrt(F.greatest(inner + between, F.lit(0.0)) / (total - 1))).when(total == 1, 0.0)
    return [
        F.min(stats["min"]).alias("min"),
        F.max(stats["max"]).alias("max"),
        F.when(total > 0, overall).alias("mean"),
        deviation.alias("std_dev"),
        F.coalesce(total, F.lit(0)).cast("bigint").alias("valid_count"),
    ]


def zonal_statistics(tiles: DataFrame, zones: DataFrame, stats: str = "stats", block: str = "block", zone: str = "zone") -> DataFrame:
    """Statistics of the tiles of each zone; ``zones`` has a row for each (zone, block)."""
    met = zones.select(F.col(zone), F.col(block)).join(tiles.select(block, stats), block)
    return met.groupBy(zone).agg(*merged(F.col(stats)))


def pyramid(tiles: DataFrame, zoom: int, stats: str = "stats", block: str = "block") -> DataFrame:
    """Statistics of the tiles inside each cell of a coarser zoom."""
    parent = cells.to_parent(F.col(block), F.lit(zoom))
    return tiles.groupBy(parent.alias(block)).agg(*merged(F.col(stats)), F.count(F.lit(1)).alias("tiles"))


def zone_cells(zones: DataFrame, cells_column: str, zone: str = "zone") -> DataFrame:
    """A row for each cell of each zone's list."""
    return zones.select(zone, F.explode(cells_column).alias("block"))
