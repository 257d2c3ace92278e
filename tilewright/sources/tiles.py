"""Tile tables: reading, writing, and views for SQL.

A tile table is Parquet with a row for each tile: ``block`` (the cell), a column for each band, and ``metadata``, which holds
the JSON document in the row of block 0. Cells are signed 64-bit here: unsigned ones, as other tools write them, are read as
decimals and cast at the boundary; ``write_tiles`` stores them signed and sorted, so that row groups can be skipped by cell.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tilewright.errors import MetadataError
from tilewright.functions import cells, geometry
from tilewright.functions.metadata import CellDescriptor, describe, read_document

#: Cells in a filter before it becomes a join.
MOST_LITERALS = 1000


def normalised(df: DataFrame, block: str = "block") -> DataFrame:
    """The table with a LONG cell column."""
    if isinstance(df.schema[block].dataType, T.LongType):
        return df
    return df.withColumn(block, F.col(block).cast("bigint"))


def read_raster_parquet(spark: SparkSession, path: str) -> DataFrame:
    """A tile table with descriptors in the fields of its bands and cells, from its metadata row."""
    df = normalised(spark.read.parquet(path))
    doc = read_document(df)
    if doc is None:
        raise MetadataError(f"{path} has no metadata row")
    binary = [f.name for f in df.schema.fields if isinstance(f.dataType, T.BinaryType)]
    found = describe(doc, binary)
    tiling = doc.get("tiling") or {}
    cell = CellDescriptor(tiling.get("min_zoom") or 0, tiling.get("max_zoom") or 0)
    marked = {name: F.col(name).alias(name, metadata=d.to_metadata()) for name, d in found.items()}
    marked["block"] = F.col("block").alias("block", metadata=cell.to_metadata())
    return df.select(*[marked.get(c, F.col(f"`{c}`")) for c in df.columns])


def read_tiles(tiles: DataFrame) -> DataFrame:
    """All tiles, without the metadata row and column."""
    return tiles.where(F.col("block") != 0).drop("metadata")


def read_metadata(tiles: DataFrame) -> DataFrame:
    """The metadata row's document."""
    return tiles.where(F.col("block") == 0).select("metadata")


def read_at(tiles: DataFrame, wkt: str, max_zoom: int | None = None, cover: bool = False) -> DataFrame:
    """Tiles under a geometry, at the table's finest zoom.

    Few cells are a filter that reaches the scan. More are made by tasks and joined, beside a range filter by the box's
    corners; the driver never holds them.
    """
    if max_zoom is None:
        try:
            max_zoom = CellDescriptor.from_field(tiles.schema["block"]).max_zoom
        except MetadataError:
            doc = read_document(tiles) or {}
            max_zoom = (doc.get("tiling") or {}).get("max_zoom")
    if max_zoom is None:
        raise MetadataError("the table tells no zoom")
    rows = read_tiles(tiles)
    if geometry.most_cells(wkt, max_zoom, cover) <= MOST_LITERALS:
        wanted = geometry.polyfill_list(wkt, max_zoom, cover)
        return rows.where(F.col("block").isin(wanted)) if wanted else rows.where(F.lit(False))
    inside = rows.where(F.col("block").between(*geometry.range_of(wkt, max_zoom, cover)))
    return inside.join(geometry.polyfill_frame(tiles.sparkSession, wkt, max_zoom, cover), "block", "left_semi")


def write_tiles(tiles: DataFrame, path: str, document: dict | None = None, mode: str = "errorifexists", row_group_bytes: int = 16 << 20) -> None:
    """Write a tile table, cells signed and in order; ``document`` becomes the metadata row."""
    df = normalised(tiles)
    if "metadata" not in df.columns:
        df = df.withColumn("metadata", F.lit(None).cast("string"))
    if document is not None:
        row = df.sparkSession.createDataFrame([(0, json.dumps(document))], "block bigint, metadata string")
        df = df.where(F.col("block") != 0).unionByName(row, allowMissingColumns=True)
    ordered = df.repartitionByRange("block").sortWithinPartitions("block")
    ordered.write.mode(mode).option("parquet.block.size", row_group_bytes).parquet(path)


def register_raster_table(spark: SparkSession, name: str, path: str) -> DataFrame:
    """Views ``name``, ``name_tiles`` and ``name_metadata`` over a tile table."""
    df = read_raster_parquet(spark, path)
    df.createOrReplaceTempView(name)
    read_tiles(df).createOrReplaceTempView(f"{name}_tiles")
    read_metadata(df).createOrReplaceTempView(f"{name}_metadata")
    return df


def create_raster_table(spark: SparkSession, name: str, path: str, replace: bool = False) -> DataFrame:
    """A table of the catalog, by DDL, over a tile table that was written; its rows stay where they are."""
    location = path.replace("'", "\\'")
    if replace:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
    spark.sql(f"CREATE TABLE {name} USING parquet LOCATION '{location}'")
    return read_table(spark, name)


def read_table(spark: SparkSession, name: str) -> DataFrame:
    """A catalog table or view as a tile table."""
    return normalised(spark.table(name))


def tiles_inside(tiles: DataFrame, cell: int, zoom: int) -> DataFrame:
    """Tiles at a zoom inside a cell, as a range of cells that prunes row groups."""
    first, last = cells.descendants(F.lit(cell), F.lit(zoom))
    return tiles.where(F.col("block").between(first, last))
