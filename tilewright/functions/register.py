"""SQL names for all functions.

Native functions become SQL functions whose body is the text of the column expression, so a query that calls them is planned
as if the expression stood there. Functions on pixels are Arrow functions. A scalar function has one result type, so there
is ``raquet_band_native_float32`` and so on, one for each pixel type, over Arrow batches; ``raquet_band_native``, whose result
type depends on its second argument, is a table function, called by LATERAL row by row.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.udtf import AnalyzeResult

from tilewright.errors import PixelTypeError
from tilewright.functions import bands, cells, codecs, geometry, metadata

TILE = "STRUCT<x: BIGINT, y: BIGINT, z: BIGINT>"
BOX = "STRUCT<min_x: DOUBLE, min_y: DOUBLE, max_x: DOUBLE, max_y: DOUBLE>"
CELLS = "ARRAY<BIGINT>"
DESCRIPTOR = "STRUCT<tile_size: INT, binary_type: STRING, data_type: STRING, no_data: STRING, compression: STRING>"
BAND = bands.BAND

_operator = re.compile(r"(?<![\w`'])(and|or|not|AND|OR|NOT|[-+*/%|&^~<>=!]+)\(")


def sql_text(column: Column) -> str:
    """An expression as SQL: operators are written as calls, which the parser takes if they are quoted."""
    return _operator.sub(lambda m: f"`{m[1].lower()}`(", column._jc.node().sql())


def native_functions(compat: bool) -> list[tuple[str, str, str, Column]]:
    """Name, parameters, result type and expression of the functions that need no Python."""
    c, r = F.col("cell"), F.col("resolution")
    cell, zoom, optional = "cell BIGINT", "resolution BIGINT", "resolution BIGINT DEFAULT NULL"
    lonlat = "lon DOUBLE, lat DOUBLE, resolution BIGINT"
    either = lambda f: F.when(r.isNull(), f(c)).otherwise(f(c, r))
    band_args = "band BINARY, tile_size STRING, binary_type STRING, data_type STRING, no_data STRING, compression STRING"
    of_band = metadata.band_metadata("band_name", "metadata")
    of_cells = metadata.quadbin_metadata("metadata")
    zooms = "STRUCT<min_zoom: INT, max_zoom: INT>"
    return [
        ("quadbin_from_tile", "x BIGINT, y BIGINT, z BIGINT", "BIGINT", cells.from_tile("x", "y", "z")),
        ("quadbin_to_tile", cell, TILE, cells.to_tile(c)),
        ("quadbin_from_lonlat", lonlat, "BIGINT", cells.from_lonlat("lon", "lat", "resolution", compat)),
        ("quadbin_to_lonlat", cell, "STRUCT<lon: DOUBLE, lat: DOUBLE>", cells.to_lonlat(c)),
        ("quadbin_to_parent", f"{cell}, {optional}", "BIGINT", either(cells.to_parent)),
        ("quadbin_resolution", cell, "INT", cells.resolution(c)),
        ("quadbin_to_children", f"{cell}, {optional}", CELLS, either(cells.to_children)),
        ("quadbin_sibling", cell, CELLS, cells.sibling(c)),
        ("quadbin_kring", f"{cell}, k BIGINT", CELLS, cells.kring(c, "k")),
        ("quadbin_to_bbox", f"{cell}, {optional}", "STRUCT<min_lon: DOUBLE, min_lat: DOUBLE, max_lon: DOUBLE, max_lat: DOUBLE>", cells.to_bbox(c)),
        ("quadbin_to_bbox_wgs84", f"{cell}, {optional}", BOX, cells.to_bbox_wgs84(c, compat=compat)),
        ("quadbin_to_bbox_mercator", f"{cell}, {optional}", BOX, cells.to_bbox_mercator(c)),
        ("quadbin_to_wkt", cell, "STRING", cells.to_wkt(c)),
        ("quadbin_to_geojson", cell, "STRING", cells.to_geojson(c)),
        ("quadbin_pixel_xy", f"{lonlat}, tile_size BIGINT", "STRUCT<pixel_x: INT, pixel_y: INT>", cells.pixel_xy("lon", "lat", "resolution", "tile_size")),
        ("quadbin_bbox_cells", f"min_lon DOUBLE, min_lat DOUBLE, max_lon DOUBLE, max_lat DOUBLE, {zoom}", CELLS, cells.bbox_cells("min_lon", "min_lat", "max_lon", "max_lat", "resolution")),
        ("raquet_band_metadata", "band_name STRING, metadata STRING", DESCRIPTOR, of_band),
        ("band_metadata", "band_name STRING, metadata STRING", DESCRIPTOR, of_band),
        ("raquet_quadbin_metadata", "metadata STRING", zooms, of_cells),
        ("quadbin_metadata", "metadata STRING", zooms, of_cells),
        ("binary_to_raquet", band_args, BAND, bands.band("band", *map(F.col, ("tile_size", "binary_type", "data_type", "no_data", "compression")))),
    ]


class NativeBand:
    """Table function: samples of a band as an array of the type named by a constant."""

    @staticmethod
    def analyze(band, data_type) -> AnalyzeResult:
        from pyspark.sql import types as T

        if data_type.value not in codecs.PIXEL_TYPES:
            raise PixelTypeError(f"unknown pixel type {data_type.value!r}")
        kinds = {"tinyint": T.ByteType(), "smallint": T.ShortType(), "int": T.IntegerType(), "bigint": T.LongType(), "float": T.FloatType(), "double": T.DoubleType()}
        element = kinds.get(codecs.PIXEL_TYPES[data_type.value][1], T.DecimalType(20, 0))
        return AnalyzeResult(schema=T.StructType([T.StructField("pixels", T.ArrayType(element))]))

    def eval(self, band, data_type):
        from decimal import Decimal

        if band is None or band["data"] is None:
            yield (None,)
            return
        data = codecs.decompress(bytes(band["data"]), band["compression"])
        samples = codecs.pixels(data, band["data_type"], band["tile_size"], max(1, len(band["bands"] or ()))).tolist() if data else []
        yield ([Decimal(x) for x in samples] if data_type == "uint64" else samples,)


def register(spark: SparkSession, compat: bool = False) -> None:
    """Make all functions callable from SQL in this session.

    ``compat`` keeps the original's deviations: metres from ``quadbin_to_bbox_wgs84``, the far-east tile 126, its choice of
    samples for statistics of floating-point bands.
    """
    for name, parameters, result, body in native_functions(compat):
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {result} RETURN {sql_text(body)}")
    spark.udf.register("raquet_decompress_bytes", bands.decompress_udf())
    fields = ", ".join(f"'{f}', band.{f}" for f in ("tile_size", "binary_type", "data_type", "no_data"))
    band = f"named_struct('data', raquet_decompress_bytes(band), {fields}, 'compression', 'none', 'bands', band.bands)"
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION raquet_decompress(band {BAND}) RETURNS {BAND} RETURN CASE WHEN band IS NOT NULL THEN {band} END")
    spark.udf.register("raquet_band_decode", bands.decode_udf())
    spark.udf.register("raquet_band_statistics", bands.statistics_udf(compat))
    spark.udf.register("raquet_pixel_of", bands.pixel_udf())
    pixel = "raquet_pixel_of(band, {x}, {y}, 0L)"
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION raquet_pixel(band {BAND}, pixel_x BIGINT, pixel_y BIGINT) RETURNS DOUBLE RETURN {pixel.format(x='pixel_x', y='pixel_y')}")
    lon, lat = bands.point("wkt")
    at = sql_text(cells.pixel_xy(lon, lat, "resolution", F.col("band.tile_size")))
    x, y = (f"CAST(({at}).{n} AS BIGINT)" for n in ("pixel_x", "pixel_y"))
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION raquet_value(band {BAND}, wkt STRING, resolution BIGINT) RETURNS DOUBLE RETURN {pixel.format(x=x, y=y)}")
    spark.udf.register("quadbin_polyfill_shapes", geometry.polyfill_udf(compat=compat))
    lon, lat = (sql_text(x) for x in bands.point("wkt"))
    at = sql_text(cells.let(F.struct(F.expr(lon).alias("lon"), F.expr(lat).alias("lat"), F.col("resolution").alias("z")), lambda p: cells.from_lonlat(p["lon"], p["lat"], p["z"], compat)))
    is_point, valid = sql_text(geometry.is_point(F.col("wkt"))), "resolution BETWEEN 0 AND 26"
    point = f"CASE WHEN ({at}) IS NOT NULL THEN array({at}) END"
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION quadbin_polyfill(wkt STRING, resolution BIGINT) RETURNS {CELLS} RETURN CASE WHEN {is_point} AND {valid} THEN {point} ELSE quadbin_polyfill_shapes(CASE WHEN NOT {is_point} THEN wkt END, resolution) END")
    for kind in codecs.PIXEL_TYPES:
        spark.udf.register(f"raquet_band_native_{kind}", bands.native_udf(kind))
    zoom = sql_text(metadata.quadbin_metadata("metadata")["max_zoom"].cast("bigint"))
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION intersects(wkt STRING, metadata STRING) RETURNS {CELLS} RETURN quadbin_polyfill(wkt, {zoom})")
    spark.udtf.register("raquet_band_native", F.udtf(NativeBand, useArrow=True))
