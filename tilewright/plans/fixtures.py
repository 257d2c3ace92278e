"""Inputs for the queries, derived from the driver's tables, which hold neither coordinates nor tiles."""

from __future__ import annotations

import gzip
import json
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tilewright.functions import bands, cells, codecs
from tilewright.functions.metadata import BandDescriptor, CellDescriptor

#: Side of the tiles made from embeddings, and the zoom and columns of their grid, as in the SQL; ``grid_zoom`` tells those
#: of a table with more rows than the grid has cells.
SIDE, ZOOM, COLUMNS = 8, 6, 64
DOCUMENT = {
    "version": "0.1.0", "compression": "gzip",
    "tiling": {"scheme": "quadbin", "block_width": SIDE, "block_height": SIDE, "min_zoom": 2, "max_zoom": ZOOM},
    "bands": [{"name": "band_1", "type": "float32", "nodata": "NaN"}, {"name": "band_2", "type": "int16", "nodata": -9999}],
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def grid_zoom(spark: SparkSession, sf_dir: str) -> int:
    """The zoom from ZOOM on whose grid has a cell for every embedding; its columns are 2 to that power."""
    last = table(spark, sf_dir, "embeddings").agg(F.max("vec_id")).first()[0]
    zoom = ZOOM
    while last is not None and last >= 1 << 2 * zoom:
        zoom += 1
    return zoom


def grid_block(zoom: int) -> Column:
    """The cell of an embedding in the grid of a zoom; an id without one is an error."""
    v = F.col("vec_id")
    block = cells.from_tile(v % (1 << zoom), F.floor(v / (1 << zoom)), F.lit(zoom))
    return F.when(block.isNull(), F.raise_error(F.format_string("vec_id %s has no cell", v.cast("string"))).cast("bigint")).otherwise(block)


def document(zoom: int) -> dict:
    """The metadata of the tile table whose grid has a zoom."""
    return {**DOCUMENT, "tiling": {**DOCUMENT["tiling"], "max_zoom": zoom}}


def tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tile of each order, at zooms 1 to 20."""
    key = F.col("o_orderkey")
    z = 1 + key % 20
    side = F.call_function("shiftleft", F.lit(1).cast("bigint"), z.cast("int"))
    return table(spark, sf_dir, "orders").select(key.alias("k"), z.alias("z"), (key * 7919 % side).alias("x"), (key * 104729 % side).alias("y"))


TILES = "SELECT o_orderkey AS k, 1 + o_orderkey % 20 AS z, (o_orderkey * 7919) % (1::BIGINT << (1 + o_orderkey % 20)) AS x, (o_orderkey * 104729) % (1::BIGINT << (1 + o_orderkey % 20)) AS y FROM orders"


def cell_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of those tiles."""
    return tiles(spark, sf_dir).select("k", cells.from_tile("x", "y", "z").alias("cell"))


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A point of each order; longitudes never fall on a tile's edge."""
    return placed_orders(table(spark, sf_dir, "orders"))


def placed_orders(orders: DataFrame) -> DataFrame:
    lon = (F.col("o_orderkey") * 7919 % 359000) / 1000 - 179.4997
    lat = (F.col("o_custkey") * 104729 % 169000) / 1000 - 84.4997
    return orders.select(F.col("o_orderkey").alias("k"), lon.alias("lon"), lat.alias("lat"))


POINTS = "SELECT o_orderkey AS k, (o_orderkey * 7919 % 359000) / 1000 - 179.4997 AS lon, (o_custkey * 104729 % 169000) / 1000 - 84.4997 AS lat FROM orders"


@cache
def pack_udf(data_type: str, packed: str):
    dtype = codecs.pixel_type(data_type)

    @F.arrow_udf("binary")
    def pack(values: pa.Array) -> pa.Array:
        out = []
        for v in values.to_pylist():
            raw = None if v is None else np.array(v, np.float64).astype(dtype).tobytes()
            out.append(raw if raw is None or packed == "none" else gzip.compress(raw, mtime=0))
        return pa.array(out, pa.binary())

    return pack


def pack(values: Column, data_type: str, packed: str = "gzip") -> Column:
    """Bytes of a band from its samples."""
    return pack_udf(data_type, packed)(values)


def thousandths(values: Column) -> Column:
    """Samples as whole thousandths, every seventh missing."""
    return F.transform(values, lambda v, i: F.when(i % 7 == 0, F.lit(-9999.0)).otherwise(F.floor(v.cast("double") * 1000).cast("double")))


def raster(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tile table of the embeddings: 8 x 8 tiles of 32-bit floats and 16-bit whole numbers, and its metadata row."""
    zoom = grid_zoom(spark, sf_dir)
    rows = table(spark, sf_dir, "embeddings").select(
        grid_block(zoom).alias("block"), pack(F.col("embedding"), "float32").alias("band_1"), pack(thousandths(F.col("embedding")), "int16").alias("band_2"), F.lit(None).cast("string").alias("metadata")
    )
    head = spark.range(1).select(F.lit(0).cast("bigint").alias("block"), F.lit(None).cast("binary").alias("band_1"), F.lit(None).cast("binary").alias("band_2"), F.lit(json.dumps(document(zoom))).alias("metadata"))
    both = rows.unionByName(head)
    float32 = BandDescriptor(SIDE, "Separated", "float32", "NaN", "gzip", ("band_1",))
    int16 = BandDescriptor(SIDE, "Separated", "int16", "-9999", "gzip", ("band_2",))
    return both.select(
        F.col("block").alias("block", metadata=CellDescriptor(2, zoom).to_metadata()),
        F.col("band_1").alias("band_1", metadata=float32.to_metadata()),
        F.col("band_2").alias("band_2", metadata=int16.to_metadata()),
        "metadata",
    )


def banded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tiles with their bands as structs."""
    df = raster(spark, sf_dir)
    return df.where(F.col("block") != 0).select("block", bands.described(df, "band_1").alias("floats"), bands.described(df, "band_2").alias("wholes"))


def cell_sql(x: str, y: str, z: str) -> str:
    """A cell in DuckDB."""
    bits = f"list_sum(list_transform(range(0, 27), lambda bit: (((({x})::BIGINT >> bit) & 1) << (2 * bit)) | (((({y})::BIGINT >> bit) & 1) << (2 * bit + 1))))::BIGINT"
    return f"(5188146770730811392::BIGINT | (({z})::BIGINT << 52) | (({bits}) << (52 - 2 * ({z})::BIGINT)) | (4503599627370495::BIGINT >> (2 * ({z})::BIGINT)))"


#: Blocks of the embeddings' tiles with their samples.
RASTER = f"SELECT {cell_sql('vec_id % 64', 'vec_id // 64', '6')} AS block, embedding, vec_id FROM embeddings"
WHOLES = "list_transform(embedding, lambda v, i: CASE WHEN (i - 1) % 7 = 0 THEN -9999.0::DOUBLE ELSE floor(v::DOUBLE * 1000) END)"
VALID = "list_filter(list_transform(embedding, lambda v, i: CASE WHEN (i - 1) % 7 = 0 THEN NULL ELSE floor(v::DOUBLE * 1000) END), lambda v: v IS NOT NULL)"
