"""Cells against published values and against plain integers."""

import json
import math
import random
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tilewright.functions import cells, geometry, rasterize
from tilewright.functions.register import register

CELL = 5256690695657226239


@pytest.fixture(scope="module")
def sql(spark):
    register(spark)
    return lambda text: spark.sql(f"SELECT {text} AS v").first().v


GOLDEN = [
    ("quadbin_from_tile(9664, 12333, 15)", CELL),
    ("quadbin_from_tile(0, 0, 0)", 5192650370358181887),
    ("quadbin_from_tile(67108863, 67108863, 26)", 5309743960669814783),
    (f"quadbin_resolution({CELL})", 15),
    ("quadbin_from_lonlat(-73.8226318359375, 40.60144147645397, 9)", 5229669105799266303),
    ("quadbin_from_lonlat(-73.98, 40.75, 13)", 5247683478069182463),
    ("quadbin_from_lonlat(-3.7038, 40.4168, 9)", 5229757908543078399),
    (f"quadbin_to_parent({CELL})", 5252187096034050047),
    (f"quadbin_to_parent({CELL}, 10)", 5234172701131669503),
    (f"quadbin_to_children({CELL})", [5261194295281451007, 5261194295282499583, 5261194295283548159, 5261194295284596735]),
    (f"quadbin_sibling({CELL})", [5256690695648837631, 5256690695653031935, 5256690695657226239, 5256690695661420543]),
    (f"quadbin_kring({CELL}, 0)", [CELL]),
    (f"quadbin_kring({CELL}, -1)", []),
    (
        f"quadbin_kring({CELL}, 1)",
        [5256690684194193407, 5256690695648837631, 5256690695653031935, 5256690684202582015, CELL, 5256690695661420543, 5256690684227747839, 5256690695682392063, 5256690695686586367],
    ),
]


@pytest.mark.parametrize(("text", "want"), GOLDEN)
def test_golden(sql, text, want):
    assert sql(text) == want


def test_golden_structs(sql):
    assert tuple(sql(f"quadbin_to_tile({CELL})")) == (9664, 12333, 15)
    assert tuple(sql("quadbin_to_tile(5202642732031410175)")) == (3, 2, 3)
    assert tuple(sql(f"quadbin_to_lonlat({CELL})")) == pytest.approx((-73.8226318359375, 40.60144147645397), abs=1e-12)
    assert tuple(sql(f"quadbin_to_bbox({CELL})")) == pytest.approx((-73.828125, 40.59727063442025, -73.817138671875, 40.60561205826018), abs=1e-12)
    assert tuple(sql(f"quadbin_to_bbox_wgs84({CELL})")) == tuple(sql(f"quadbin_to_bbox({CELL}, 3)"))
    assert tuple(sql(f"quadbin_to_bbox_mercator({CELL})")) == pytest.approx((-8218509.281222152, 4953119.432879422, -8217286.288769588, 4954342.425331984), abs=1e-6)
    assert tuple(sql("quadbin_pixel_xy(-3.7038, 40.4168, 9, 256)")) == (187, 14)
    assert tuple(sql("quadbin_pixel_xy(0, 0, 9, 256)")) == (0, 0)


def test_texts(sql):
    assert sql("quadbin_to_wkt(quadbin_from_tile(1, 1, 1))").startswith("POLYGON((0 -85.0511287798")
    # a cell beside the origin has corners too small for plain Java numbers
    text = sql("quadbin_to_wkt(quadbin_from_tile(33554432, 33554431, 26))")
    assert "E" not in text and "0.0000053644" in text
    doc = json.loads(sql(f"quadbin_to_geojson({CELL})"))
    assert doc["type"] == "Polygon" and doc["coordinates"][0][0] == doc["coordinates"][0][4]


@pytest.mark.parametrize(
    "text",
    [
        "quadbin_from_tile(NULL, 0, 1)", "quadbin_from_tile(2, 0, 1)", "quadbin_from_tile(-1, 0, 1)", "quadbin_from_tile(0, 0, 27)", "quadbin_to_tile(NULL)",
        "quadbin_from_lonlat(NULL, 0, 3)", "quadbin_from_lonlat(0, 0, 27)", "quadbin_from_lonlat(0, 0, -1)", "quadbin_to_lonlat(NULL)", "quadbin_to_parent(NULL)",
        f"quadbin_to_parent({CELL}, 16)", f"quadbin_to_children({CELL}, 14)", "quadbin_to_children(quadbin_from_tile(0, 0, 26))", "quadbin_kring(NULL, 1)", f"quadbin_kring({CELL}, NULL)",
        "quadbin_sibling(NULL)", "quadbin_to_bbox(NULL)", "quadbin_to_wkt(NULL)", "quadbin_to_geojson(NULL)", "quadbin_pixel_xy(0, 0, 3, 0)", "quadbin_pixel_xy(0, NULL, 3, 256)",
    ],
)
def test_without_a_meaning_is_null(sql, text):
    assert sql(text) is None


def test_edges(sql):
    assert sql("quadbin_to_parent(quadbin_from_tile(0, 0, 0))") == sql("quadbin_from_tile(0, 0, 0)")
    assert sql("quadbin_sibling(quadbin_from_tile(0, 0, 0))") == sql("quadbin_to_children(quadbin_from_tile(0, 0, 0))")
    assert sql("quadbin_from_lonlat(180, -90, 5)") == sql("quadbin_from_tile(31, 31, 5)")
    assert sql("quadbin_from_lonlat(-500, 90, 5)") == sql("quadbin_from_tile(0, 0, 5)")
    assert len(sql("quadbin_kring(quadbin_from_tile(0, 0, 3), 1)")) == 4


def test_compat(spark):
    register(spark, compat=True)
    try:
        one = spark.sql("SELECT quadbin_to_bbox_wgs84(quadbin_from_tile(0, 0, 1)) AS b, quadbin_to_tile(quadbin_from_lonlat(180, 0, 9)).x AS x, quadbin_to_tile(quadbin_from_lonlat(180, 0, 5)).x AS y").first()
        assert one.b.min_x < -2e7 and one.x == 126 and one.y == 31
    finally:
        register(spark)


def test_round_trip_at_all_zooms(spark):
    rnd = random.Random(1)
    rows = [(rnd.randrange(1 << z), rnd.randrange(1 << z), z) for z in range(27) for _ in range(40)]
    df = spark.createDataFrame(rows, "x long, y long, z long").withColumn("cell", cells.from_tile("x", "y", "z"))
    for r in df.select("*", cells.to_tile("cell").alias("t"), cells.to_parent("cell").alias("p"), cells.to_children("cell").alias("c")).collect():
        assert r.cell == geometry.encode_tile(r.x, r.y, r.z) and tuple(r.t) == (r.x, r.y, r.z)
        if r.z:
            assert r.p == geometry.encode_tile(r.x // 2, r.y // 2, r.z - 1)
        if r.z < 26:
            assert r.c == [geometry.encode_tile(2 * r.x + i % 2, 2 * r.y + i // 2, r.z + 1) for i in range(4)]


def test_descendants_are_a_range(spark):
    df = spark.range(1).select(F.lit(geometry.encode_tile(2, 1, 2)).alias("cell"))
    first, last = df.select(*cells.descendants("cell", F.lit(5))).first()
    inside = [geometry.encode_tile(x, y, 5) for x in range(32) for y in range(32) if x // 8 == 2 and y // 8 == 1]
    assert all(first <= c <= last for c in inside) and sum(first <= geometry.encode_tile(x, y, 5) <= last for x in range(32) for y in range(32)) == 64


def test_cells_are_plain_expressions(spark, sql):
    # constants are folded, calls leave nothing but expressions, and they run in generated code
    plan = spark.sql(f"SELECT quadbin_to_parent({CELL}, 10) AS p")._jdf.queryExecution().optimizedPlan().toString()
    assert "5234172701131669503" in plan
    df = spark.range(10).select(cells.from_tile("id", "id", F.lit(5)).alias("c"))
    text = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in text and "*(1)" in text


# -- geometries

RING = "POLYGON((-45 40.9798980696201, 0 40.9798980696201, 0 66.5132604431119, -45 66.5132604431119, -45 40.9798980696201))"


def test_polyfill_golden(sql):
    want = [5206706527007670271, 5206724119193714687, 5207093555100647423, 5207111147286691839, 5207128739472736255, 5207146331658780671]
    assert geometry.polyfill_list(RING, 4) == want == sql(f"quadbin_polyfill('{RING}', 4L)")
    assert geometry.polyfill_tiles(RING, 5) == [(x, y) for y in range(7, 12) for x in range(12, 16)]


def tiles_of(found):
    return set(zip(*(v.tolist() for v in found), strict=True))


def plain_line(a, b, width, height):
    """Cells that hold a point of the line, its eastern end left out, or lie south or east of such a point, by fractions."""
    (x0, y0), (x1, y1) = sorted([a, b])
    if x0 == x1 or y0 == y1:
        clamp = lambda v, n: min(max(v, 0), n - 1)
        if x0 == x1:
            return {(x0, y) for y in range(clamp(min(y0, y1), height), clamp(max(y0, y1), height) + 1) if 0 <= x0 < width}
        return {(x, y0) for x in range(clamp(x0, width), clamp(x1, width) + 1) if 0 <= y0 < height}
    slope = Fraction(y1 - y0, x1 - x0)
    # the floor changes only where a coordinate is whole: take these places and the middles between them
    at = {Fraction(x) for x in range(x0, x1)} | {x0 + (y - y0) / slope for y in range(min(y0, y1), max(y0, y1) + 1)}
    at = sorted(x for x in at if x0 <= x < x1)
    at += [(p + q) / 2 for p, q in zip(at, [*at[1:], Fraction(x1)], strict=True)]
    found = {(math.floor(x), math.floor(y0 + (x - x0) * slope)) for x in at}
    return {(x, y) for x, y in found if 0 <= x < width and 0 <= y < height}


@settings(max_examples=300, deadline=None)
@given(*[st.integers(0, 14)] * 4, st.integers(1, 15), st.integers(1, 15))
def test_lines_equal_a_plain_walk(x0, y0, x1, y1, w, h):
    line = np.array([[x0, y0, x1, y1]], float)
    whole = plain_line((x0, y0), (x1, y1), w, h) if max(y0, y1) >= 0 and min(y0, y1) <= h and min(x0, x1) <= w else set()
    assert tiles_of(geometry.line_cells(line, w, h)) == whole
    middle = h // 2
    assert tiles_of(geometry.line_cells(line, w, h, (0, middle))) | tiles_of(geometry.line_cells(line, w, h, (middle, h))) == whole


def plain_polygon(rings, width, height):
    """Cells by crossings of the middle of each row, one by one, and borders by plain lines."""
    edges = [(a, b) for r in rings for a, b in zip(r, [*r[1:], r[0]], strict=True) if a != b]
    found = set().union(*(plain_line(a, b, width, height) for a, b in edges))
    for row in range(height):
        m = row + Fraction(1, 2)
        crossed = sorted(math.floor((m - a[1]) * Fraction(b[0] - a[0], b[1] - a[1]) + a[0] + Fraction(1, 2)) for a, b in edges if min(a[1], b[1]) <= m < max(a[1], b[1]))
        found |= {(x, row) for p, q in zip(crossed[::2], crossed[1::2], strict=True) for x in range(max(p, 0), min(q, width))}
    return found


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.tuples(st.integers(0, 12), st.integers(0, 12)), min_size=3, max_size=7, unique=True), min_size=1, max_size=3))
def test_polygons_equal_a_plain_fill(rings):
    closed = [[*r, r[0]] for r in rings]
    want = plain_polygon(rings, 12, 12)
    assert tiles_of(geometry.polygon_cells(closed, 12, 12)) == want
    bands = [tiles_of(geometry.polygon_cells(closed, 12, 12, (y, y + 4))) for y in (0, 4, 8)]
    assert set().union(*bands) == want and all(4 * i <= y < 4 * i + 4 for i, b in enumerate(bands) for _, y in b)


def test_cells_of_a_large_geometry_are_made_by_tasks(spark, monkeypatch):
    text = "MULTIPOLYGON(((-170 80, 170 70, 100 -60, -120 -80, -170 80), (-20 20, 20 20, 20 -20, -20 -20, -20 20)), ((175 10, 179 10, 179 -10, 175 10)))"
    want = geometry.polyfill_list(text, 8)
    monkeypatch.setattr(geometry, "BAND_CELLS", 1 << 10)
    frame = geometry.polyfill_frame(spark, text, 8)
    assert sorted(r.block for r in frame.collect()) == sorted(want) and frame.rdd.getNumPartitions() > 10
    low, high = geometry.range_of(text, 8)
    assert low <= min(want) and max(want) <= high and len(want) <= geometry.most_cells(text, 8)
    assert geometry.polyfill_frame(spark, "POLYGON EMPTY", 5).count() == 0


def test_triangle():
    rows = {}
    for x, y in tiles_of(geometry.polygon_cells([[(0, 6), (8, 6), (4, 0), (0, 6)]], 8, 6)):
        rows.setdefault(y, []).append(x)
    # the eastern side passes the corner (6, 3) exactly: column 6 is entered in row 3, and (6, 2), which it meets in that
    # corner only and which a walk in rounded numbers takes, is not on it
    assert {y: (min(v), max(v)) for y, v in rows.items()} == {0: (3, 4), 1: (2, 5), 2: (2, 5), 3: (1, 6), 4: (0, 7), 5: (0, 7)}
    assert sum(map(len, rows.values())) == 32


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 11), st.integers(1, 11))
def test_rectangles_are_half_open(w, h):
    ring = [(0, 0), (w, 0), (w, h), (0, h), (0, 0)]
    assert tiles_of(geometry.polygon_cells([ring], w, h)) == {(x, y) for x in range(w) for y in range(h)}


def test_holes_and_many_parts():
    outer, hole = [(0, 0), (9, 0), (9, 9), (0, 9), (0, 0)], [(3, 3), (6, 3), (6, 6), (3, 6), (3, 3)]
    found = tiles_of(geometry.polygon_cells([outer, hole], 9, 9))
    assert (4, 4) not in found and (3, 3) in found and (1, 1) in found
    square = "((0 0, 20 0, 20 20, 0 20, 0 0))"
    two = geometry.polyfill_list(f"MULTIPOLYGON({square}, ((40 0, 60 0, 60 20, 40 20, 40 0)))", 5)
    assert set(geometry.polyfill_list(f"POLYGON{square}", 5)) < set(two)
    assert set(geometry.polyfill_list(f"GEOMETRYCOLLECTION(POINT(1 1), POLYGON{square})", 5)) >= set(geometry.polyfill_list(f"POLYGON{square}", 5))
    assert len(geometry.polyfill_list("LINESTRING(0 10, 90 10)", 4)) == 4
    assert len(geometry.polyfill_list("POLYGON((1 1, 2 1, 2 2, 1 2, 1 1))", 3)) == 1
    assert geometry.polyfill_list("MULTIPOINT((0 0), 0 0)", 3) == geometry.polyfill_list("POINT Z (0 0 5)", 3)
    assert geometry.polyfill_list("POLYGON EMPTY", 3) == []


@pytest.mark.parametrize("text", ["", "POINT", "POINT(1)", "CIRCLE(1 2)", "POINT(1 2) x", "POLYGON((0 0, 1 1)", "POINT(a b)", "POINT(1 2;"])
def test_bad_texts(text):
    with pytest.raises(geometry.GeometryError):
        geometry.parse(text)


def test_extent():
    assert geometry.tile_extent(RING, 4) == (6, 3, 8, 6)
    assert geometry.tile_extent("GEOMETRYCOLLECTION(POINT(-45 60), LINESTRING(0 41, 0 66))", 4) == (6, 4, 8, 5)
    with pytest.raises(geometry.GeometryError):
        geometry.tile_extent("POINT EMPTY", 4)


def test_polyfill_column(spark):
    rows = spark.createDataFrame([(RING,), ("POINT(-3.7038 40.4168)",), (None,)], "w string")
    got = [r.c for r in rows.select(geometry.polyfill("w", F.lit(4)).alias("c")).collect()]
    assert got == [geometry.polyfill_list(RING, 4), geometry.polyfill_list("POINT(-3.7038 40.4168)", 4), None]


def test_tile_of_matches_columns(spark):
    rnd = random.Random(3)
    rows = [(rnd.uniform(-190, 190), rnd.uniform(-89, 89)) for _ in range(500)]
    df = spark.createDataFrame(rows, "lon double, lat double").select("*", cells.to_tile(cells.from_lonlat("lon", "lat", F.lit(11))).alias("t"))
    assert all((r.t.x, r.t.y) == geometry.tile_of((r.lon, r.lat), 11) for r in df.collect())
    assert math.isclose(cells.MAX_LATITUDE, 85.0511287798066)


def test_shapes_are_burnt_into_arrays():
    box, three = rasterize.rectangle(1, 1, 4, 3), rasterize.triangle((0, 4), (4, 4), (0, 0))
    one = rasterize.rasterize([(box, 2)], 5, 5, dtype="int32")
    # the box and the southern and eastern borders, which the lines touch
    assert one.tolist() == [[0] * 5, [0, 2, 2, 2, 2], [0, 2, 2, 2, 2], [0, 2, 2, 2, 2], [0] * 5]
    both = rasterize.rasterize([(box, 2), (three, 3)], 5, 5, merge="add", background=1, dtype="int32")
    alone = rasterize.rasterize([(three, 3)], 5, 5, dtype="int32")
    assert (both == 1 + one + alone).all() and (rasterize.rasterize([(box, 2), (three, 3)], 5, 5) == np.where(alone, 3, one)).all()
    labels = rasterize.labelled([box, "POINT(0 0)", "MULTIPOINT(4 4, 9 9)", "LINESTRING(0 0, 0 2)"], 5, 5)
    assert labels[0, 0] == 4 and labels[4, 4] == 3 and labels[2, 2] == 1 and labels[0, 4] == 0
    assert (rasterize.touched([box, three], 5, 5) == ((one > 0) | (alone > 0))).all()
    # a grid of half units from (10, 20) down
    world = "POLYGON((10.5 19.5, 12 19.5, 12 18.5, 10.5 18.5, 10.5 19.5))"
    assert (rasterize.rasterize([(world, 2)], 5, 5, transform=(0.5, 0, 10, 0, -0.5, 20)) == one).all()
    for bad in (lambda: rasterize.rasterize([(box, 1)], 2, 2, merge="most"), lambda: rasterize.rasterize([(box, 1)], 2, 2, transform=(0, 0, 0, 0, 0, 0)), lambda: rasterize.rasterize([(("CIRCLE", None), 1)], 2, 2)):
        with pytest.raises(geometry.GeometryError):
            bad()


def test_rings_of_all_sizes(spark):
    rows = [(x, y, z) for z in (0, 1, 3, 20, 26) for x, y in ((0, 0), ((1 << z) - 1, (1 << z) - 1), ((1 << z) // 2, 0), ((1 << z) // 3, (1 << z) // 2))]
    df = spark.createDataFrame(rows, "x long, y long, z long").withColumn("cell", cells.from_tile("x", "y", "z"))
    sizes = (0, 1, 2, 4, 7)
    got = df.select("x", "y", "z", *[cells.kring("cell", k).alias(f"fixed{k}") for k in sizes], *[cells.kring("cell", F.lit(k) + 0 * F.col("x")).alias(f"own{k}") for k in sizes], cells.kring("cell", -1).alias("less"), cells.kring(F.lit(None).cast("long"), 1).alias("none"))
    for r in got.collect():
        n = 1 << r.z
        for k in sizes:
            want = [geometry.encode_tile(x, y, r.z) for y in range(max(0, r.y - k), min(n, r.y + k + 1)) for x in range(max(0, r.x - k), min(n, r.x + k + 1))]
            assert r[f"fixed{k}"] == want == r[f"own{k}"], (r.x, r.y, r.z, k)
        assert r.less == [] and r.none is None


def test_descendants_of_many_levels(spark):
    df = spark.createDataFrame([(1, 0, 1, 4), (3, 2, 2, 2), (0, 0, 0, 3), (5, 6, 25, 26), (1, 1, 3, 2), (0, 0, 26, 27)], "x long, y long, z long, r long").withColumn("cell", cells.from_tile("x", "y", "z"))
    for r in df.select("x", "y", "z", "r", cells.to_children("cell", "r").alias("c")).collect():
        n = 1 << max(0, r.r - r.z)
        want = [geometry.encode_tile(r.x * n + i, r.y * n + j, r.r) for j in range(n) for i in range(n)] if r.z <= r.r <= 26 else None
        assert r.c == want
