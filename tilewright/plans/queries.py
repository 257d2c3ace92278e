"""Queries over the driver's tables, one or more for each function of the library, and SQL that gives the same rows.

Lists are exploded, structs are flattened, doubles are rounded: both sides then compare row by row.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tilewright.functions import bands, cells, codecs, geometry, metadata
from tilewright.functions.register import register
from tilewright.operators import burn, lookup, zonal
from tilewright.plans import fixtures as fx
from tilewright.sources import tiles as source
from tilewright.sources.shared import shared_path
from tilewright.streaming import points as stream

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

#: Decimals that both engines' trigonometry agrees on.
DECIMALS = 8


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Enter a query, and SQL for its rows, under a name."""

    def enter(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return enter


def rounded(c: Column, name: str) -> Column:
    # adding zero turns -0.0 into 0.0
    return (F.round(c, DECIMALS) + 0.0).alias(name)


def round_sql(expression: str, name: str) -> str:
    return f"round({expression}, {DECIMALS}) + 0.0 AS {name}"


# -- cells ---------------------------------------------------------------------------------------------------------------

WITH_TILES = f"WITH t AS ({fx.TILES})"
CELL = fx.cell_sql("x", "y", "z")


@query("from_tile", f"{WITH_TILES} SELECT k, {CELL} AS cell FROM t")
def from_tile(spark, sf_dir):
    return fx.cell_rows(spark, sf_dir)


@query("to_tile", f"{WITH_TILES} SELECT k, x, y, z FROM t")
def to_tile(spark, sf_dir):
    return fx.cell_rows(spark, sf_dir).select("k", cells.to_tile("cell").alias("t")).select("k", "t.x", "t.y", "t.z")


@query("resolution", f"{WITH_TILES} SELECT k, z::INT AS resolution FROM t")
def resolution(spark, sf_dir):
    return fx.cell_rows(spark, sf_dir).select("k", cells.resolution("cell").alias("resolution"))


def _tile_y(z: int) -> str:
    return f"greatest(0, least((1::BIGINT << {z}) - 1, floor((1 - asinh(tan(lat * pi() / 180)) / pi()) / 2 * (1::BIGINT << {z}))::BIGINT))"


def _tile_x(z: int) -> str:
    return f"greatest(0, least((1::BIGINT << {z}) - 1, floor((lon + 180) / 360 * (1::BIGINT << {z}))::BIGINT))"


POINT_ZOOMS = (5, 12, 20, 26)


@query("from_lonlat", f"WITH p AS ({fx.POINTS}) SELECT k, " + ", ".join(f"{fx.cell_sql(_tile_x(z), _tile_y(z), str(z))} AS cell_{z}" for z in POINT_ZOOMS) + " FROM p")
def from_lonlat(spark, sf_dir):
    return fx.points(spark, sf_dir).select("k", *[cells.from_lonlat("lon", "lat", z).alias(f"cell_{z}") for z in POINT_ZOOMS])


def _lon(x: str) -> str:
    return f"({x}) / (1::BIGINT << z)::DOUBLE * 360 - 180"


def _lat(y: str) -> str:
    return f"degrees(atan(sinh(pi() * (1 - 2 * ({y}) / (1::BIGINT << z)::DOUBLE))))"


@query("to_lonlat", f"{WITH_TILES} SELECT k, {round_sql(_lon('x + 0.5'), 'lon')}, {round_sql(_lat('y + 0.5'), 'lat')} FROM t")
def to_lonlat(spark, sf_dir):
    return fx.cell_rows(spark, sf_dir).select("k", cells.to_lonlat("cell").alias("p")).select("k", rounded(F.col("p.lon"), "lon"), rounded(F.col("p.lat"), "lat"))


@query("parent", f"{WITH_TILES} SELECT k, {fx.cell_sql('x // 2', 'y // 2', 'z - 1')} AS parent FROM t")
def parent(spark, sf_dir):
    return fx.cell_rows(spark, sf_dir).select("k", cells.to_parent("cell").alias("parent"))


@query("parent_at", f"{WITH_TILES} SELECT k, {fx.cell_sql('x >> (z - z // 2)', 'y >> (z - z // 2)', 'z // 2')} AS parent FROM t")
def parent_at(spark, sf_dir):
    coarse = F.floor(cells.resolution("cell") / 2)
    return fx.cell_rows(spark, sf_dir).select("k", cells.to_parent("cell", coarse).alias("parent"))


def _children(levels: int) -> str:
    n = 1 << levels
    return f"{WITH_TILES}, c AS (SELECT k, z, x, y, unnest(range(0, {n * n})) AS i FROM t) SELECT k, i::INT AS place, {fx.cell_sql(f'x * {n} + i % {n}', f'y * {n} + i // {n}', f'z + {levels}')} AS child FROM c"


def _listed(df: DataFrame, cells_list: Column, name: str) -> DataFrame:
    return df.select("k", F.posexplode(cells_list).alias("place", name))


@query("children", _children(1))
def children(spark, sf_dir):
    return _listed(fx.cell_rows(spark, sf_dir), cells.to_children("cell"), "child")


@query("children_at", _children(2))
def children_at(spark, sf_dir):
    return _listed(fx.cell_rows(spark, sf_dir), cells.to_children("cell", cells.resolution("cell") + 2), "child")


@query("sibling", f"{WITH_TILES}, c AS (SELECT k, z, x, y, unnest(range(0, 4)) AS i FROM t) SELECT k, i::INT AS place, {fx.cell_sql('x // 2 * 2 + i % 2', 'y // 2 * 2 + i // 2', 'z')} AS cell FROM c")
def sibling(spark, sf_dir):
    return _listed(fx.cell_rows(spark, sf_dir), cells.sibling("cell"), "cell")


KRING = f"""{WITH_TILES}, c AS (SELECT k, z, x, y, unnest(range(-2, 3)) AS dy FROM t), d AS (SELECT *, unnest(range(-2, 3)) AS dx FROM c)
SELECT k, (row_number() OVER (PARTITION BY k ORDER BY dy, dx) - 1)::INT AS place, {fx.cell_sql('x + dx', 'y + dy', 'z')} AS cell
FROM d WHERE x + dx BETWEEN 0 AND (1::BIGINT << z) - 1 AND y + dy BETWEEN 0 AND (1::BIGINT << z) - 1"""


@query("kring", KRING)
def kring(spark, sf_dir):
    return _listed(fx.cell_rows(spark, sf_dir), cells.kring("cell", 2), "cell")


@query("corner", f"{WITH_TILES} SELECT k, {round_sql(_lon('x'), 'lon')}, {round_sql(_lat('y'), 'lat')} FROM t")
def corner(spark, sf_dir):
    return fx.cell_rows(spark, sf_dir).select("k", cells.to_corner("cell").alias("p")).select("k", rounded(F.col("p.lon"), "lon"), rounded(F.col("p.lat"), "lat"))


@query("validity", f"{WITH_TILES} SELECT k, true AS cell, false AS broken, x < (1::BIGINT << (z - 1)) AND y < (1::BIGINT << (z - 1)) AS above FROM t")
def validity(spark, sf_dir):
    t = fx.tiles(spark, sf_dir).withColumn("c", cells.from_tile("x", "y", "z"))
    return t.select("k", cells.is_cell("c").alias("cell"), cells.is_cell(F.col("c") - 1).alias("broken"), cells.is_tile("x", "y", F.col("z") - 1).alias("above"))


MERCATOR_POINTS = f"""WITH p AS ({fx.POINTS}) SELECT k, round(radians(lon) * 6378137.0, 3) + 0.0 AS x, round(ln(tan(pi() / 4 + radians(lat) / 2)) * 6378137.0, 3) + 0.0 AS y,
round(lon, 7) + 0.0 AS lon, round(lat, 7) + 0.0 AS lat FROM p"""


@query("mercator_xy", MERCATOR_POINTS)
def mercator_xy(spark, sf_dir):
    p = fx.points(spark, sf_dir).select("k", cells.lon_to_x("lon").alias("x"), cells.lat_to_y("lat").alias("y"))
    back = {"lon": F.round(cells.x_to_lon("x"), 7), "lat": F.round(cells.y_to_lat("y"), 7)}
    return p.select("k", *[(F.round(c, 3) + 0.0).alias(c) for c in "xy"], *[(v + 0.0).alias(n) for n, v in back.items()])


DEGREES = (_lon("x"), _lat("y + 1"), _lon("x + 1"), _lat("y"))
HALF = "pi() * 6378137.0"


def _box(names: tuple[str, ...], values) -> str:
    return f"{WITH_TILES} SELECT k, {', '.join(round_sql(v, n) for v, n in zip(values, names, strict=True))} FROM t"


def _box_query(f: Callable[[Column], Column], names: tuple[str, ...]) -> Query:
    def run(spark, sf_dir):
        return fx.cell_rows(spark, sf_dir).select("k", f(F.col("cell")).alias("b")).select("k", *[rounded(F.col(f"b.{n}"), n) for n in names])

    return run


LONLAT_BOX = ("min_lon", "min_lat", "max_lon", "max_lat")
query("bbox", _box(LONLAT_BOX, DEGREES))(_box_query(cells.to_bbox, LONLAT_BOX))
query("bbox_wgs84", _box(cells.CORNERS, DEGREES))(_box_query(cells.to_bbox_wgs84, cells.CORNERS))


def _metres(v: str) -> str:
    return f"({v}) / (1::BIGINT << z)::DOUBLE * 2 * {HALF}"


MERCATOR = (f"{_metres('x')} - {HALF}", f"{HALF} - {_metres('y + 1')}", f"{_metres('x + 1')} - {HALF}", f"{HALF} - {_metres('y')}")


@query("bbox_mercator", f"{WITH_TILES} SELECT k, " + ", ".join(f"round({v}, 3) + 0.0 AS {n}" for v, n in zip(MERCATOR, cells.CORNERS, strict=True)) + " FROM t")
def bbox_mercator(spark, sf_dir):
    found = fx.cell_rows(spark, sf_dir).select("k", cells.to_bbox_mercator("cell").alias("b"))
    return found.select("k", *[(F.round(f"b.{n}", 3) + 0.0).alias(n) for n in cells.CORNERS])


RING = [("min_lon", "min_lat"), ("max_lon", "min_lat"), ("max_lon", "max_lat"), ("min_lon", "max_lat"), ("min_lon", "min_lat")]
#: Texts differ in the last digits of latitudes, so the numbers in them are compared, rounded, in their order.
CORNER_ROWS = f"""{WITH_TILES}, b AS (SELECT k, {', '.join(f'{v} AS {n}' for v, n in zip(DEGREES, LONLAT_BOX, strict=True))} FROM t),
r AS (SELECT k, unnest(range(0, 10)) AS place, unnest([{', '.join(n for p in RING for n in p)}]) AS v FROM b)
SELECT k, place::INT AS place, {round_sql('v', 'number')}"""


def _numbers(df: DataFrame, text: Column, shape: str) -> DataFrame:
    """The numbers of a text in their order, beside the text without them."""
    # a text is made, and its shape looked at, below the place where its numbers are unnested: once, not for each number
    read = df.select("k", text.alias("text")).select("k", "text", (F.regexp_replace("text", "-?[0-9.]+", "#") == shape).alias("formed"))
    found = read.select("k", "formed", F.posexplode(F.regexp_extract_all("text", F.lit("(-?[0-9.]+)"), F.lit(1))).alias("place", "n"))
    return found.select("k", "place", rounded(F.col("n").cast("double"), "number"), "formed")


@query("wkt", CORNER_ROWS + ", true AS formed FROM r")
def wkt(spark, sf_dir):
    return _numbers(fx.cell_rows(spark, sf_dir), cells.to_wkt("cell"), "POLYGON((# #,# #,# #,# #,# #))")


@query("geojson", CORNER_ROWS + ", true AS formed FROM r")
def geojson(spark, sf_dir):
    # JSON may write exponents, so its numbers are read by a parser
    doc = F.from_json(cells.to_geojson("cell"), "type STRING, coordinates ARRAY<ARRAY<ARRAY<DOUBLE>>>")
    read = fx.cell_rows(spark, sf_dir).select("k", doc.alias("doc")).select("k", "doc", (F.col("doc.type") == "Polygon").alias("formed"))
    found = read.select("k", "formed", F.posexplode(F.flatten(F.col("doc.coordinates")[0])).alias("place", "n"))
    return found.select("k", "place", rounded(F.col("n"), "number"), "formed")


PIXEL_SIZE, PIXEL_ZOOM = 256, 9


def _pixel(fraction: str) -> str:
    return f"least({PIXEL_SIZE - 1}, floor(({fraction} - floor({fraction})) * {PIXEL_SIZE}))::INT"


X_FRACTION = f"((lon + 180) / 360 * {1 << PIXEL_ZOOM})"
Y_FRACTION = f"((1 - asinh(tan(lat * pi() / 180)) / pi()) / 2 * {1 << PIXEL_ZOOM})"


@query("pixel_xy", f"WITH p AS ({fx.POINTS}) SELECT k, {_pixel(X_FRACTION)} AS pixel_x, {_pixel(Y_FRACTION)} AS pixel_y FROM p")
def pixel_xy(spark, sf_dir):
    return fx.points(spark, sf_dir).select("k", cells.pixel_xy("lon", "lat", PIXEL_ZOOM, PIXEL_SIZE).alias("p")).select("k", "p.*")


# -- geometries ----------------------------------------------------------------------------------------------------------

FILL_ZOOM = 7


@query("polyfill_point", f"WITH p AS ({fx.POINTS}) SELECT k, {fx.cell_sql(_tile_x(FILL_ZOOM), _tile_y(FILL_ZOOM), str(FILL_ZOOM))} AS cell FROM p")
def polyfill_point(spark, sf_dir):
    text = F.format_string("POINT(%s %s)", F.col("lon").cast("string"), F.col("lat").cast("string"))
    return fx.points(spark, sf_dir).select("k", F.explode(geometry.polyfill(text, FILL_ZOOM)).alias("cell"))


#: The edge of the Mercator map, where boxes of points near it end.
EDGE_LON, EDGE_LAT = 180.0, 85.05112877980659
WIDE, HIGH = 7.3, 5.1


def rectangles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A box of a few degrees at the point of every order, cut off at the map's edge."""
    # one small file: its rows are dealt to all cores, since filling costs more than reading
    p = fx.points(spark, sf_dir).repartition(spark.sparkContext.defaultParallelism).withColumn("east", F.least(F.col("lon") + WIDE, F.lit(EDGE_LON))).withColumn("north", F.least(F.col("lat") + HIGH, F.lit(EDGE_LAT)))
    return p.select("k", "lon", "lat", "east", "north", F.concat(F.lit("POLYGON("), ring(SOUTH_WEST, SOUTH_EAST, NORTH_EAST, NORTH_WEST), F.lit(")")).alias("wkt"))


SOUTH_WEST, SOUTH_EAST, NORTH_EAST, NORTH_WEST = ("lon", "lat"), ("east", "lat"), ("east", "north"), ("lon", "north")


def ring(*corners: tuple[str, str]) -> Column:
    """The text of a ring of corners."""
    return F.concat(F.lit("("), F.concat_ws(", ", *[F.concat_ws(" ", *[F.col(c).cast("string") for c in xy]) for xy in (*corners, corners[0])]), F.lit(")"))


def _boxes_sql(z: int, last: int = 0) -> str:
    """Boxes in tiles: first column and row, columns and rows; ``last`` is 1 where the last column and row are in."""
    return f"""WITH p AS ({fx.POINTS}), b AS (SELECT k, {_tile_x(z)} AS x0, {_tile_y(z)} AS y1 FROM p),
e AS (SELECT k, {_tile_x(z)} AS x1, {_tile_y(z)} AS y0 FROM (SELECT k, least(lon + {WIDE}, {EDGE_LON}::DOUBLE) AS lon, least(lat + {HIGH}, {EDGE_LAT}::DOUBLE) AS lat FROM p)),
r AS (SELECT b.k, x0, y0, x1 - x0 AS dx, y1 - y0 AS dy, greatest(x1 - x0 + {last}, 1) AS w, greatest(y1 - y0 + {last}, 1) AS h FROM b JOIN e ON b.k = e.k)"""


def _rectangle_sql(z: int, last: int) -> str:
    """Tiles of the boxes."""
    return f"""{_boxes_sql(z, last)}, c AS (SELECT k, x0, y0, w, unnest(range(0, w * h)) AS i FROM r)
SELECT k, {fx.cell_sql('x0 + i % w', 'y0 + i // w', str(z))} AS cell FROM c"""


@query("polyfill_rect", _rectangle_sql(FILL_ZOOM, 0))
def polyfill_rect(spark, sf_dir):
    return rectangles(spark, sf_dir).select("k", F.explode(geometry.polyfill("wkt", FILL_ZOOM)).alias("cell"))


@query("polyfill_cover", _rectangle_sql(FILL_ZOOM, 1))
def polyfill_cover(spark, sf_dir):
    return rectangles(spark, sf_dir).select("k", F.explode(geometry.polyfill("wkt", FILL_ZOOM, cover=True)).alias("cell"))


@query("bbox_cells", _rectangle_sql(FILL_ZOOM, 1))
def bbox_cells(spark, sf_dir):
    return rectangles(spark, sf_dir).select("k", F.explode(cells.bbox_cells("lon", "lat", "east", "north", FILL_ZOOM)).alias("cell"))


#: A line from a box's south-west to its north-east: in each column the rows between its heights at the column's sides, the
#: farther one included where the line only reaches it; upright and level lines take all of their grid.
LINE = f"""{_boxes_sql(FILL_ZOOM)}, c AS (SELECT *, unnest(range(0, w)) AS x FROM r),
s AS (SELECT *, CASE WHEN dx = 0 OR dy = 0 THEN 0 ELSE dy * (dx - x - 1) // dx END AS lo, CASE WHEN dx = 0 OR dy = 0 THEN h - 1 ELSE least(dy - 1, dy * (dx - x) // dx) END AS hi FROM c),
t AS (SELECT *, unnest(range(lo, hi + 1)) AS y FROM s) SELECT k, {fx.cell_sql('x0 + x', 'y0 + y', str(FILL_ZOOM))} AS cell FROM t"""


@query("polyfill_line", LINE)
def polyfill_line(spark, sf_dir):
    text = F.format_string("LINESTRING(%s, %s)", *[F.concat_ws(" ", *[F.col(c).cast("string") for c in xy]) for xy in (SOUTH_WEST, NORTH_EAST)])
    return rectangles(spark, sf_dir).select("k", F.explode(geometry.polyfill(text, FILL_ZOOM)).alias("cell"))


#: The half of a box below its diagonal from north-west to south-east: cells left of where the diagonal crosses the middle
#: of a row, cells that the diagonal passes, and the western column; of a box without width or height all of its grid.
TRIANGLE = f"""{_boxes_sql(FILL_ZOOM)}, c AS (SELECT *, unnest(range(0, w * h)) AS i FROM r), d AS (SELECT *, i % w AS x, i // w AS y FROM c)
SELECT k, {fx.cell_sql('x0 + x', 'y0 + y', str(FILL_ZOOM))} AS cell FROM d
WHERE dx = 0 OR dy = 0 OR x = 0 OR x < ((2 * y + 1) * dx + dy) // (2 * dy) OR y BETWEEN dy * x // dx AND (dy * (x + 1) - 1) // dx"""


@query("polyfill_triangle", TRIANGLE)
def polyfill_triangle(spark, sf_dir):
    text = F.concat(F.lit("POLYGON("), ring(SOUTH_WEST, SOUTH_EAST, NORTH_WEST), F.lit(")"))
    return rectangles(spark, sf_dir).select("k", F.explode(geometry.polyfill(text, FILL_ZOOM)).alias("cell"))


HOLE_ZOOM = 8
#: What a hole's corners are away from its box's, in degrees: borders of the hole count, so only cells between them are out.
HOLE_X, HOLE_Y = (1.1, 6.4), (0.7, 4.5)


def _inner(i: int, z: int) -> str:
    return f"SELECT k, {_tile_x(z)} AS hx{i}, {_tile_y(z)} AS hy{i} FROM (SELECT k, least(lon + {HOLE_X[i]}, {EDGE_LON}::DOUBLE) AS lon, least(lat + {HOLE_Y[i]}, {EDGE_LAT}::DOUBLE) AS lat FROM p)"


HOLED = f"""{_boxes_sql(HOLE_ZOOM)}, i0 AS ({_inner(0, HOLE_ZOOM)}), i1 AS ({_inner(1, HOLE_ZOOM)}), c AS (SELECT *, unnest(range(0, w * h)) AS i FROM r),
d AS (SELECT c.k, x0 + i % w AS x, y0 + i // w AS y, hx0, hx1, hy0, hy1 FROM c JOIN i0 ON c.k = i0.k JOIN i1 ON c.k = i1.k)
SELECT k, {fx.cell_sql('x', 'y', str(HOLE_ZOOM))} AS cell FROM d WHERE NOT (x > hx0 AND x < hx1 AND y > hy1 AND y < hy0)"""


@query("polyfill_hole", HOLED)
def polyfill_hole(spark, sf_dir):
    df = rectangles(spark, sf_dir)
    for i in range(2):
        df = df.withColumn(f"hx{i}", F.least(F.col("lon") + HOLE_X[i], F.lit(EDGE_LON))).withColumn(f"hy{i}", F.least(F.col("lat") + HOLE_Y[i], F.lit(EDGE_LAT)))
    inner = ring(("hx0", "hy0"), ("hx0", "hy1"), ("hx1", "hy1"), ("hx1", "hy0"))
    text = F.concat(F.lit("POLYGON("), ring(SOUTH_WEST, SOUTH_EAST, NORTH_EAST, NORTH_WEST), F.lit(", "), inner, F.lit(")"))
    return df.select("k", F.explode(geometry.polyfill(text, HOLE_ZOOM)).alias("cell"))


def _burnt(value: str) -> str:
    return f"SELECT cell AS block, {value} AS value FROM ({_rectangle_sql(FILL_ZOOM, 0)}) GROUP BY cell"


@query("burn_add", _burnt("sum(1 + k % 5)::BIGINT"))
def burn_add(spark, sf_dir):
    return burn.burn(rectangles(spark, sf_dir).select("wkt", (1 + F.col("k") % 5).alias("v")), FILL_ZOOM, "v", merge="add")


@query("burn_label", _burnt("max(k)"))
def burn_label(spark, sf_dir):
    return burn.burn(rectangles(spark, sf_dir).select("wkt", "k"), FILL_ZOOM, "k")


# -- metadata ------------------------------------------------------------------------------------------------------------

MADE_DOCUMENTS = "SELECT o_orderkey AS k, 1 + o_orderkey % 9 AS low, 10 + o_orderkey % 11 AS high, 'b' || (o_orderkey % 3) AS wanted, CASE o_orderkey % 3 WHEN 0 THEN 'gzip' WHEN 1 THEN 'zip' END AS packed FROM orders"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A metadata document of each order, and a band's name that two thirds of them know."""
    k = F.col("o_orderkey")
    made = [
        k.alias("k"), (1 + k % 9).cast("int").alias("low"), (10 + k % 11).cast("int").alias("high"),
        F.concat(F.lit("b"), (k % 3).cast("string")).alias("wanted"), F.when(k % 3 == 0, "gzip").when(k % 3 == 1, "zip").alias("packed"),
    ]
    rows = fx.table(spark, sf_dir, "orders").select(*made)
    shown = F.coalesce(F.concat(F.lit('"'), "packed", F.lit('"')), F.lit("null"))
    text = F.format_string(
        '{"version":"0.1.0","compression":%s,"tiling":{"block_width":16,"block_height":16,"min_zoom":%d,"max_zoom":%d},"bands":[{"name":"b0","type":"uint8","nodata":7},{"name":"b1","type":"float64"}]}',
        shown, "low", "high",
    )
    return rows.select("k", "wanted", text.alias("metadata"))


@query("quadbin_metadata", f"SELECT k, low::INT AS min_zoom, high::INT AS max_zoom FROM ({MADE_DOCUMENTS})")
def quadbin_metadata(spark, sf_dir):
    return documents(spark, sf_dir).select("k", metadata.quadbin_metadata("metadata").alias("m")).select("k", "m.*")


@query(
    "band_metadata",
    f"""SELECT k, CASE WHEN wanted <> 'b2' THEN 16 END::INT AS tile_size, CASE WHEN wanted <> 'b2' THEN 'Separated' END AS binary_type,
CASE wanted WHEN 'b0' THEN 'uint8' WHEN 'b1' THEN 'float64' END AS data_type, CASE WHEN wanted <> 'b2' THEN '7' END AS no_data,
CASE WHEN wanted <> 'b2' THEN CASE WHEN packed = 'gzip' THEN 'gzip' ELSE 'none' END END AS compression FROM ({MADE_DOCUMENTS})""",
)
def band_metadata(spark, sf_dir):
    return documents(spark, sf_dir).select("k", metadata.band_metadata("wanted", "metadata").alias("m")).select("k", "m.*")


@query(
    "intersects_join",
    f"""WITH p AS ({fx.POINTS}), r AS ({fx.RASTER}), c AS (SELECT k, {fx.cell_sql(_tile_x(fx.ZOOM), _tile_y(fx.ZOOM), str(fx.ZOOM))} AS block FROM p)
SELECT c.k, r.block, r.vec_id FROM c JOIN r ON c.block = r.block""",
)
def intersects_join(spark, sf_dir):
    zoom = fx.grid_zoom(spark, sf_dir)
    document = json.dumps(fx.document(zoom))
    text = F.format_string("POINT(%s %s)", F.col("lon").cast("string"), F.col("lat").cast("string"))
    wanted = fx.points(spark, sf_dir).select("k", F.explode(geometry.intersects(text, F.lit(document))).alias("block"))
    tiles = fx.table(spark, sf_dir, "embeddings").select(fx.grid_block(zoom).alias("block"), "vec_id")
    return wanted.join(tiles, "block").select("k", "block", "vec_id")


# -- bands ---------------------------------------------------------------------------------------------------------------

WITH_RASTER = f"WITH r AS ({fx.RASTER})"


@query("band_descriptor", f"{WITH_RASTER} SELECT block, 8::INT AS tile_size, 'Separated' AS binary_type, 'float32' AS data_type, 'NaN' AS no_data, 'gzip' AS compression FROM r")
def band_descriptor(spark, sf_dir):
    names = ("tile_size", "binary_type", "data_type", "no_data", "compression")
    return fx.banded(spark, sf_dir).select("block", *[F.col(f"floats.{n}").alias(n) for n in names])


def _packed_sql(lists: str) -> str:
    return f"{WITH_RASTER}, l AS (SELECT block, unnest(range(0, len(embedding))) AS place, unnest({lists}) AS v FROM r) SELECT block, place::INT AS place, v"


@query("decompress", f"{WITH_RASTER} SELECT block, 256::INT AS bytes, 'none' AS compression, 128::INT AS whole_bytes FROM r")
def decompress(spark, sf_dir):
    df = fx.banded(spark, sf_dir).select("block", bands.decompress("floats").alias("f"), bands.decompress("wholes").alias("w"))
    return df.select("block", F.length("f.data").alias("bytes"), F.col("f.compression").alias("compression"), F.length("w.data").alias("whole_bytes"))


@query("decode", _packed_sql("embedding") + "::DOUBLE AS pixel FROM l")
def decode(spark, sf_dir):
    return fx.banded(spark, sf_dir).select("block", F.posexplode(bands.decode("floats")).alias("place", "pixel"))


@query("native_float32", _packed_sql("embedding") + "::FLOAT AS pixel FROM l")
def native_float32(spark, sf_dir):
    return fx.banded(spark, sf_dir).select("block", F.posexplode(bands.native("floats", "float32")).alias("place", "pixel"))


@query("native_int16", _packed_sql(fx.WHOLES) + "::SMALLINT AS pixel FROM l")
def native_int16(spark, sf_dir):
    return fx.banded(spark, sf_dir).select("block", F.posexplode(bands.native("wholes", "int16")).alias("place", "pixel"))


def _statistics_sql(lists: str) -> str:
    return f"""SELECT block, list_min({lists})::DOUBLE AS min, list_max({lists})::DOUBLE AS max, {round_sql(f'list_avg(list_transform({lists}, lambda v: v::DOUBLE))', 'mean')},
{round_sql(f'list_stddev_samp(list_transform({lists}, lambda v: v::DOUBLE))', 'std_dev')}, len({lists})::BIGINT AS valid_count FROM r"""


def _flat(df: DataFrame) -> DataFrame:
    return df.select("block", "s.min", "s.max", rounded(F.col("s.mean"), "mean"), rounded(F.col("s.std_dev"), "std_dev"), "s.valid_count")


@query("statistics", f"{WITH_RASTER} {_statistics_sql('embedding')}")
def statistics(spark, sf_dir):
    return _flat(fx.banded(spark, sf_dir).select("block", bands.statistics("floats").alias("s")))


@query("statistics_no_data", f"{WITH_RASTER} {_statistics_sql(fx.VALID)}")
def statistics_no_data(spark, sf_dir):
    return _flat(fx.banded(spark, sf_dir).select("block", bands.statistics("wholes").alias("s")))


@query("statistics_sql", f"{WITH_RASTER} {_statistics_sql('embedding')}")
def statistics_sql(spark, sf_dir):
    """The same by SQL names: bytes get their descriptor in the query."""
    register(spark)
    fx.raster(spark, sf_dir).createOrReplaceTempView("tilewright_raster")
    return _flat(spark.sql("SELECT block, raquet_band_statistics(binary_to_raquet(band_1, '8', 'Separated', 'float32', 'NaN', 'gzip')) AS s FROM tilewright_raster WHERE block <> 0"))


@query("pixel", f"{WITH_RASTER} SELECT block, embedding[(vec_id % 8) * 8 + vec_id % 5 + 1]::DOUBLE AS inside, NULL::DOUBLE AS outside FROM r")
def pixel(spark, sf_dir):
    df = fx.raster(spark, sf_dir).where("block <> 0")
    # the tile's place tells the row that it was made of
    number = cells.tile_y(F.col("block")) * (1 << fx.grid_zoom(spark, sf_dir)) + cells.tile_x(F.col("block"))
    band = bands.described(df, "band_1")
    return df.select("block", bands.pixel(band, number % 5, number % 8).alias("inside"), bands.pixel(band, F.lit(8), F.lit(0)).alias("outside"))


VALUE = f"""WITH p AS ({fx.POINTS}), r AS ({fx.RASTER}),
c AS (SELECT k, {fx.cell_sql(_tile_x(fx.ZOOM), _tile_y(fx.ZOOM), str(fx.ZOOM))} AS block, (lon + 180) / 360 * 64 AS fx, (1 - asinh(tan(lat * pi() / 180)) / pi()) / 2 * 64 AS fy FROM p)
SELECT c.k, r.block, embedding[floor((fy - floor(fy)) * 8)::INT * 8 + floor((fx - floor(fx)) * 8)::INT + 1]::DOUBLE AS value FROM c JOIN r ON c.block = r.block"""


@query("value", VALUE)
def value(spark, sf_dir):
    text = F.format_string("POINT(%s %s)", F.col("lon").cast("string"), F.col("lat").cast("string"))
    zoom = fx.grid_zoom(spark, sf_dir)
    met = lookup.join_points(fx.points(spark, sf_dir), fx.banded(spark, sf_dir), zoom)
    return met.select("k", "block", bands.value("floats", text, zoom).alias("value"))


@query("sample_points", VALUE)
def sample_points(spark, sf_dir):
    tiles = fx.banded(spark, sf_dir).select("block", "floats")
    return lookup.sample_points(fx.points(spark, sf_dir), tiles, fx.grid_zoom(spark, sf_dir), "floats").select("k", "block", "value")


# -- tables --------------------------------------------------------------------------------------------------------------


@query("read_tiles", f"{WITH_RASTER} SELECT block, 2::INT AS bands FROM r")
def read_tiles(spark, sf_dir):
    df = source.read_tiles(fx.raster(spark, sf_dir))
    return df.select("block", F.lit(len(df.columns) - 1).alias("bands"))


@query("read_metadata", "SELECT 1::BIGINT AS documents, 2::INT AS min_zoom, 6::INT AS max_zoom, 'band_1' AS first_band")
def read_metadata(spark, sf_dir):
    doc = metadata.document("metadata")
    rows = source.read_metadata(fx.raster(spark, sf_dir)).select(metadata.quadbin_metadata("metadata").alias("z"), doc["bands"][0]["name"].alias("first_band"))
    return rows.groupBy("z.min_zoom", "z.max_zoom", "first_band").agg(F.count(F.lit(1)).alias("documents"))


#: Tiles x 3..8, y 2..5 of zoom 6; the last column and row are out.
READ_AT = "POLYGON((-160 84.6, -131 84.6, -131 82.7, -160 82.7, -160 84.6))"
READ_AT_SQL = f"""WITH r AS ({fx.RASTER}), b AS (SELECT -160.0 AS w, -131.0 AS e, 84.6 AS n, 82.7 AS s),
x AS (SELECT floor((w + 180) / 360 * 64) AS x0, floor((e + 180) / 360 * 64) AS x1, floor((1 - asinh(tan(radians(n))) / pi()) / 2 * 64) AS y0, floor((1 - asinh(tan(radians(s))) / pi()) / 2 * 64) AS y1 FROM b)
SELECT r.block FROM r, x WHERE vec_id % 64 >= x0 AND vec_id % 64 < greatest(x1, x0 + 1) AND vec_id // 64 >= y0 AND vec_id // 64 < greatest(y1, y0 + 1)"""


@query("read_at", READ_AT_SQL)
def read_at(spark, sf_dir):
    return source.read_at(fx.raster(spark, sf_dir), READ_AT).select("block")


@query("tiles_inside", f"{WITH_RASTER} SELECT block FROM r WHERE vec_id % 64 BETWEEN 16 AND 31 AND vec_id // 64 < 16")
def tiles_inside(spark, sf_dir):
    zone = geometry.encode_tile(1, 0, 2)
    return source.tiles_inside(source.read_tiles(fx.raster(spark, sf_dir)), zone, fx.grid_zoom(spark, sf_dir)).select("block")


# -- over tiles ----------------------------------------------------------------------------------------------------------


def _merged_sql(key: str, more: str = "") -> str:
    return f"""SELECT {key}, min(v)::DOUBLE AS min, max(v)::DOUBLE AS max, round(avg(v::DOUBLE), 6) + 0.0 AS mean, round(stddev_samp(v::DOUBLE), 6) + 0.0 AS std_dev, count(*)::BIGINT AS valid_count{more}"""


def _merged(df: DataFrame, *more: str) -> DataFrame:
    six = [(F.round(c, 6) + 0.0).alias(c) for c in ("mean", "std_dev")]
    return df.select(df.columns[0], "min", "max", *six, "valid_count", *more)


@query(
    "zonal_stats",
    f"WITH r AS ({fx.RASTER}), e AS (SELECT label::INT AS zone, unnest(embedding) AS v FROM embeddings) {_merged_sql('zone')} FROM e GROUP BY zone",
)
def zonal_stats(spark, sf_dir):
    zones = fx.table(spark, sf_dir, "embeddings").select(F.col("label").cast("int").alias("zone"), fx.grid_block(fx.grid_zoom(spark, sf_dir)).alias("block"))
    tiles = fx.banded(spark, sf_dir).select("block", bands.statistics("floats").alias("stats"))
    return _merged(zonal.zonal_statistics(tiles, zones))


@query(
    "pyramid_rollup",
    f"WITH e AS (SELECT vec_id % 64 // 4 AS x, vec_id // 64 // 4 AS y, unnest(embedding) AS v FROM embeddings), s AS ({_merged_sql('x, y', ', count(*)::BIGINT // 64 AS tiles')} FROM e GROUP BY x, y) SELECT {fx.cell_sql('x', 'y', '4')} AS block, min, max, mean, std_dev, valid_count, tiles FROM s",
)
def pyramid_rollup(spark, sf_dir):
    tiles = fx.banded(spark, sf_dir).select("block", bands.statistics("floats").alias("stats"))
    return _merged(zonal.pyramid(tiles, 4), "tiles")


#: Tiles under the boxes, with what they were made of.
UNDER_BOXES = f"SELECT c.k, e.* FROM ({_rectangle_sql(fx.ZOOM, 0)}) c JOIN (SELECT {fx.cell_sql('vec_id % 64', 'vec_id // 64', '6')} AS block, vec_id, embedding FROM embeddings) e ON c.cell = e.block"


@query("geometry_join", f"SELECT k, block FROM ({UNDER_BOXES})")
def geometry_join(spark, sf_dir):
    tiles = fx.banded(spark, sf_dir).select("block")
    return lookup.join_geometries(rectangles(spark, sf_dir).select("k", "wkt"), tiles, fx.grid_zoom(spark, sf_dir)).select("k", "block")


@query("zones_by_geometry", f"WITH e AS (SELECT k AS zone, unnest(embedding) AS v FROM ({UNDER_BOXES})) {_merged_sql('zone')} FROM e GROUP BY zone")
def zones_by_geometry(spark, sf_dir):
    zones = rectangles(spark, sf_dir).select(F.col("k").alias("zone"), geometry.polyfill("wkt", fx.grid_zoom(spark, sf_dir)).alias("cells"))
    tiles = fx.banded(spark, sf_dir).select("block", bands.statistics("floats").alias("stats"))
    return _merged(zonal.zonal_statistics(tiles, zonal.zone_cells(zones, "cells")))


# -- tile files ----------------------------------------------------------------------------------------------------------


def tile_file(spark: SparkSession, sf_dir: str) -> str:
    """The path of a tile table of the embeddings, written anew: cells in order, in small row groups, and its metadata row."""
    path = shared_path(spark, "tiles")
    source.write_tiles(source.read_tiles(fx.raster(spark, sf_dir)), path, fx.document(fx.grid_zoom(spark, sf_dir)), row_group_bytes=1 << 14)
    return path


@query("file_statistics", f"{WITH_RASTER} {_statistics_sql('embedding')}")
def file_statistics(spark, sf_dir):
    """Tiles of a file, whose descriptors come from its metadata row."""
    df = source.read_raster_parquet(spark, tile_file(spark, sf_dir))
    return _flat(source.read_tiles(df).select("block", bands.statistics(bands.described(df, "band_1")).alias("s")))


#: Tile x 5, y 3: the 198th.
ONE_TILE = 3 * 64 + 5


@query("file_block", f"{WITH_RASTER}, o AS (SELECT * FROM r WHERE vec_id = {ONE_TILE}) {_statistics_sql('embedding').replace('FROM r', 'FROM o')}")
def file_block(spark, sf_dir):
    """One tile of a file, by a filter that skips row groups."""
    zoom = fx.grid_zoom(spark, sf_dir)
    df = source.read_raster_parquet(spark, tile_file(spark, sf_dir))
    cell = geometry.encode_tile(ONE_TILE % (1 << zoom), ONE_TILE >> zoom, zoom)
    return _flat(df.where(F.col("block") == cell).select("block", bands.statistics(bands.described(df, "band_1")).alias("s")))


@query("file_at", READ_AT_SQL)
def file_at(spark, sf_dir):
    """Tiles of a file under a geometry."""
    return source.read_at(source.read_raster_parquet(spark, tile_file(spark, sf_dir)), READ_AT).select("block")


@query("file_metadata", "SELECT 1::BIGINT AS documents, 2::INT AS min_zoom, 6::INT AS max_zoom, 'band_1' AS first_band")
def file_metadata(spark, sf_dir):
    doc = metadata.document("metadata")
    rows = source.read_metadata(source.read_raster_parquet(spark, tile_file(spark, sf_dir))).select(metadata.quadbin_metadata("metadata").alias("z"), doc["bands"][0]["name"].alias("first_band"))
    return rows.groupBy("z.min_zoom", "z.max_zoom", "first_band").agg(F.count(F.lit(1)).alias("documents"))


@query("file_ddl", _packed_sql("embedding") + "::FLOAT AS pixel FROM l")
def file_ddl(spark, sf_dir):
    """A table made by DDL over a file, and samples of its native type by SQL."""
    register(spark)
    source.create_raster_table(spark, "tilewright_tiles", tile_file(spark, sf_dir), replace=True)
    band = "binary_to_raquet(band_1, '8', 'Separated', 'float32', 'NaN', 'gzip')"
    return spark.sql(f"SELECT block, posexplode(pixels) AS (place, pixel) FROM (SELECT block, raquet_band_native_float32({band}) AS pixels FROM tilewright_tiles WHERE block <> 0)")


#: Whole numbers that all pixel types hold.
SMALL = "list_transform(embedding, lambda v: floor(abs(v::DOUBLE) * 1000)::BIGINT % 100)"


@query("native_types", f"{WITH_RASTER}, l AS (SELECT block, unnest(range(0, len(embedding))) AS place, unnest({SMALL}) AS v FROM r) SELECT kind, block, place::INT AS place, v::DOUBLE AS pixel FROM l, (SELECT unnest({sorted(codecs.PIXEL_TYPES)}) AS kind)")
def native_types(spark, sf_dir):
    """Samples of each pixel type, packed and decoded again."""
    small = F.transform("embedding", lambda v: (F.floor(F.abs(v.cast("double")) * 1000) % 100).cast("double"))
    rows = fx.table(spark, sf_dir, "embeddings").select(fx.grid_block(fx.grid_zoom(spark, sf_dir)).alias("block"), small.alias("v"))
    each = []
    for kind in sorted(codecs.PIXEL_TYPES):
        band = bands.band(fx.pack(F.col("v"), kind), fx.SIDE, data_type=kind, compression="gzip")
        each.append(rows.select(F.lit(kind).alias("kind"), "block", F.posexplode(bands.native(band, kind).cast("array<double>")).alias("place", "pixel")))
    return reduce(DataFrame.unionByName, each)


@query("stream_cells", f"WITH p AS ({fx.POINTS}) SELECT k, {fx.cell_sql(_tile_x(9), _tile_y(9), '9')} AS block FROM p")
def stream_cells(spark, sf_dir):
    """Points read as a stream until it is used up, with their cells."""
    orders = fx.table(spark, sf_dir, "orders")
    # brackets make the path a pattern, as a stream takes no single file
    rows = spark.readStream.schema(orders.schema).parquet(f"{sf_dir}/order[s].parquet")
    out = shared_path(spark, "stream")
    located = stream.with_cells(fx.placed_orders(rows), 9).select("k", "block")
    located.writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("k bigint, block bigint").parquet(f"{out}/rows")
