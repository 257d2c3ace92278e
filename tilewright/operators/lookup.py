"""Joins of points and geometries with tiles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tilewright.functions import bands, cells, geometry


def join_points(points: DataFrame, tiles: DataFrame, zoom: int, lon: str = "lon", lat: str = "lat") -> DataFrame:
    """Points with the tile that holds them: an equi-join on the cell, which adaptive execution may split or broadcast."""
    located = points.withColumn("block", cells.from_lonlat(F.col(lon), F.col(lat), F.lit(zoom)))
    return located.join(tiles, "block")


#: Points of one tile that a task takes; the tile goes to more tasks if it has more.
TASK_POINTS = 1 << 20
#: Tiles with more points than that, as a table that is broadcast.
HOT_TILES = 100_000


def sample_points(points: DataFrame, tiles: DataFrame, zoom: int, band: str, lon: str = "lon", lat: str = "lat") -> DataFrame:
    """Points with ``value``, the band's sample under them, and the tile's other columns.

    Points never carry a band: tiles and points are dealt by the cell, and a task that streams through them, each tile
    before its points, decodes a tile once. The points of a crowded tile are dealt to several tasks, with a copy of it each.
    """
    own = [c for c in points.columns if c != "block"]
    more = [c for c in tiles.columns if c not in ("block", band)]
    at = cells.pixel_xy(F.col(lon), F.col(lat), F.lit(zoom), F.lit(1 << 15))  # of a tile's side, in 32,768ths
    located = points.select(F.struct(*own).alias("point"), cells.from_lonlat(F.col(lon), F.col(lat), F.lit(zoom)).alias("block"), at.alias("at")).where("block IS NOT NULL")
    crowded = located.groupBy("block").count().where(F.col("count") > TASK_POINTS).select("block", F.ceil(F.col("count") / TASK_POINTS).cast("int").alias("copies"))
    few = crowded.limit(HOT_TILES + 1).count()
    if few:
        side = F.broadcast(crowded) if few <= HOT_TILES else crowded
        copies = F.coalesce("copies", F.lit(1))
        located = located.join(side, "block", "left").withColumn("copy", F.pmod(F.xxhash64("point"), copies).cast("int")).drop("copies")
        dealt = tiles.join(side, "block", "left").withColumn("copy", F.explode(F.sequence(F.lit(0), copies - 1))).drop("copies")
    else:
        located, dealt = located.withColumn("copy", F.lit(0)), tiles.withColumn("copy", F.lit(0))
    rows = dealt.select("block", "copy", F.lit(0).alias("kind"), F.col(band).alias("band"), F.struct(F.lit(0).alias("none"), *more).alias("tile")).unionByName(
        located.select("block", "copy", F.lit(1).alias("kind"), "at", "point"), allowMissingColumns=True
    )
    # a number of partitions that adaptive execution leaves alone: decoding costs more than the bytes tell
    n = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.select("block", "copy", "kind", "band", "at", "tile", "point").repartition(n, "block", "copy").sortWithinPartitions("block", "copy", "kind")
    kinds = {f.name: f.dataType for f in rows.schema.fields}
    out = T.StructType([T.StructField("block", T.LongType()), T.StructField("tile", kinds["tile"]), T.StructField("point", kinds["point"]), T.StructField("value", T.DoubleType())])
    found = rows.mapInArrow(bands.sampler(out), out)
    return found.select("block", *[F.col("point").getField(c).alias(c) for c in own], *[F.col("tile").getField(c).alias(c) for c in more], "value")


def join_geometries(geometries: DataFrame, tiles: DataFrame, zoom: int, wkt: str = "wkt", cover: bool = False) -> DataFrame:
    """Geometries with the tiles they cover: cells are unnested and joined by equality."""
    unnested = geometries.withColumn("block", F.explode(geometry.polyfill(wkt, F.lit(zoom), cover)))
    return unnested.join(tiles, "block")
