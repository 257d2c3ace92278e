"""QUADBIN cells as column expressions.

A cell is a 64-bit number: a fixed header, five bits of zoom, the bits of x and y in turn from the highest, then ones. All
functions build Catalyst expressions, so they run in generated code, fold over constants and are pushed down like any other.
Null arguments give null, and so do arguments without a meaning: a zoom outside 0..26, a tile outside its grid, a parent
finer than the cell, children coarser than it.
"""

from __future__ import annotations

import math
from functools import cache, reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the cell format and of Web Mercator.
HEADER = 0x4000000000000000
MODE = 0x0800000000000000
FOOTER = 0x000FFFFFFFFFFFFF
MAX_RESOLUTION = 26
MAX_LATITUDE = 85.0511287798066
EARTH_RADIUS = 6378137.0
NIBBLES = range(0, 28, 4)
PAIR_NIBBLES = range(0, 52, 4)

ColumnOrNumber = Column | int | float


def col(x: ColumnOrNumber | str) -> Column:
    """A column of a column, a column's name or a number."""
    return x if isinstance(x, Column) else F.col(x) if isinstance(x, str) else F.lit(x)


def long(x: ColumnOrNumber | str) -> Column:
    return col(x).cast("bigint")


def left(x: Column, bits: Column) -> Column:
    return F.call_function("shiftleft", x, bits.cast("int"))


def right(x: Column, bits: Column) -> Column:
    return F.call_function("shiftright", x, bits.cast("int"))


@cache
def table(kind: str) -> Column:
    """Constant arrays for four bits at a time: ``spread`` moves them to even places, ``compact`` takes the even ones."""
    values = [sum((v >> i & 1) << 2 * i for i in range(4)) if kind == "spread" else (v & 1) | (v >> 1 & 2) for v in range(16)]
    return F.expr("array(" + ", ".join(f"{v}L" for v in values) + ")")


def looked_up(kind: str, v: Column, places: range, step: int) -> Column:
    """Bits of a number by table: four from each place, to ``step`` times as far."""
    parts = [F.shiftleft(F.get(table(kind), F.shiftright(v, i).bitwiseAND(F.lit(15)).cast("int")), int(i * step / 2)) for i in places]
    return reduce(Column.bitwiseOR, parts)


def spread_bits(v: Column) -> Column:
    """Bits of a number below 2^28 at the even places."""
    return looked_up("spread", v, NIBBLES, 4)


def compact_bits(v: Column) -> Column:
    """Bits at the even places of a number below 2^52, side by side."""
    return looked_up("compact", v, PAIR_NIBBLES, 1)


def encode(x: Column, y: Column, z: Column, there: Column | None = None) -> Column:
    """A cell of LONG columns; null where ``there`` is not true.

    The condition stands on the constant part only, so that common parts of the rest are computed once and a constant zoom
    folds.
    """
    head = F.lit(HEADER | MODE) if there is None else F.when(there, F.lit(HEADER | MODE))
    pairs = spread_bits(x).bitwiseOR(F.shiftleft(spread_bits(y), 1))
    return head.bitwiseOR(F.shiftleft(z, 52)).bitwiseOR(left(pairs, 52 - 2 * z)).bitwiseOR(right(F.lit(FOOTER), 2 * z))


def grid(z: Column) -> Column:
    """Tiles along a side at a zoom, as LONG; null at no zoom."""
    return F.when(valid_zoom(z), left(F.lit(1).cast("bigint"), z))


def valid_zoom(z: Column) -> Column:
    return (z >= 0) & (z <= MAX_RESOLUTION)


def from_tile(x, y, z) -> Column:
    """The cell of a tile."""
    x, y, z = long(x), long(y), long(z)
    return encode(x, y, z, valid_zoom(z) & (x >= 0) & (y >= 0) & (x < grid(z)) & (y < grid(z)))


def zoom(cell: Column) -> Column:
    return F.shiftright(cell, 52).bitwiseAND(F.lit(31).cast("bigint"))


def pairs_of(cell: Column) -> Column:
    """The x and y bits of a cell in turn, as a small number."""
    return right(cell.bitwiseAND(F.lit(FOOTER)), 52 - 2 * zoom(cell))


def tile_x(cell: Column) -> Column:
    return compact_bits(pairs_of(cell))


def tile_y(cell: Column) -> Column:
    return compact_bits(F.shiftright(pairs_of(cell), 1))


def resolution(cell) -> Column:
    """The zoom of a cell."""
    return zoom(long(cell)).cast("int")


def to_tile(cell) -> Column:
    """STRUCT(x, y, z)."""
    c = long(cell)
    return F.when(c.isNotNull(), F.struct(tile_x(c).alias("x"), tile_y(c).alias("y"), zoom(c).alias("z")))


def radians(degrees: Column) -> Column:
    return degrees * math.pi / 180.0


def mercator_fraction(lat: Column) -> Column:
    """How far down the map a latitude is, 0 to 1; the logarithm form keeps its digits for negative latitudes."""
    t = F.tan(radians(F.greatest(F.least(lat, F.lit(MAX_LATITUDE)), F.lit(-MAX_LATITUDE))))
    return (1.0 - F.signum(t) * F.ln(F.abs(t) + F.sqrt(t * t + 1.0)) / math.pi) / 2.0


def side(z: Column) -> Column:
    return grid(z).cast("double")


def clamped(v: Column, z: Column, last: Column) -> Column:
    return F.greatest(F.lit(0).cast("bigint"), F.least(F.floor(v).cast("bigint"), last))


def located(lon: Column, lat: Column) -> Column:
    """Whether both are numbers; ``least`` and ``greatest`` would pass over a null."""
    return lon.isNotNull() & lat.isNotNull() & ~F.isnan(lon) & ~F.isnan(lat)


def tile_at(lon: Column, lat: Column, z: Column, compat: bool = False) -> tuple[Column, Column]:
    """The tile of a point in DOUBLE degrees at a LONG zoom."""
    last = grid(z) - 1
    x, y = (lon + 180.0) / 360.0 * side(z), mercator_fraction(lat) * side(z)
    tx, ty = clamped(x, z, last), clamped(y, z, last)
    if compat:
        saturated = F.least(grid(z), F.lit(127).cast("bigint")) - 1
        tx = F.when(F.floor(x) >= grid(z), saturated).otherwise(tx)
        ty = F.when(F.floor(y) >= grid(z), saturated).otherwise(ty)
    return tx, ty


def from_lonlat(lon, lat, resolution, compat: bool = False) -> Column:
    """The cell of a point. Points beyond the map belong to its border tiles.

    ``compat``: from zoom 7 on, points at the far east get the tile 126, as an 8-bit overflow of the original has it.
    """
    lon, lat, z = col(lon).cast("double"), col(lat).cast("double"), long(resolution)
    return encode(*tile_at(lon, lat, z, compat), z, valid_zoom(z) & located(lon, lat))


def lon_at(x: Column, z: Column) -> Column:
    """Longitude of a place in tiles from the west."""
    return x / side(z) * 360.0 - 180.0


def lat_at(y: Column, z: Column) -> Column:
    """Latitude of a place in tiles from the north."""
    return F.atan(F.sinh(math.pi * (1.0 - 2.0 * y / side(z)))) * 180.0 / math.pi


def to_lonlat(cell) -> Column:
    """STRUCT(lon, lat) of the cell's centre."""
    c = long(cell)
    z = zoom(c)
    return F.when(c.isNotNull(), F.struct(lon_at(tile_x(c) + 0.5, z).alias("lon"), lat_at(tile_y(c) + 0.5, z).alias("lat")))


def at_zoom(cell: Column, z: Column) -> Column:
    """The cell's bits with another zoom and its footer."""
    cleared = cell.bitwiseAND(F.lit(~(31 << 52)))
    return cleared.bitwiseOR(F.shiftleft(z, 52)).bitwiseOR(right(F.lit(FOOTER), 2 * z))


def to_parent(cell, resolution=None) -> Column:
    """The cell that holds this one, one level up (the root is its own parent) or at a zoom."""
    c = long(cell)
    z = F.greatest(zoom(c) - 1, F.lit(0).cast("bigint")) if resolution is None else long(resolution)
    return F.when((z >= 0) & (z <= zoom(c)), at_zoom(c, z))


def to_children(cell, resolution=None) -> Column:
    """All cells inside, one level down or at a zoom, row by row."""
    c = long(cell)
    z = zoom(c)
    if resolution is None:
        stride = left(F.lit(1).cast("bigint"), 50 - 2 * z)
        first = c.bitwiseAND(F.bitwise_not(right(F.lit(FOOTER), 2 * z)))
        first = at_zoom(first, z + 1)
        return F.when(z < MAX_RESOLUTION, F.array(*[first + stride * i for i in range(4)]))
    r = long(resolution)
    # the bits of a child's place inside the cell stand right of the cell's own
    inside = (r >= z) & (r <= MAX_RESOLUTION)
    places = F.transform(F.sequence(F.lit(0).cast("bigint"), grid(r - z) - 1), spread_bits)
    unit = 52 - 2 * r
    first = at_zoom(c.bitwiseAND(F.bitwise_not(right(F.lit(FOOTER), 2 * z))), r)
    found = let(F.struct(places.alias("p"), first.alias("f"), unit.alias("u")), lambda t: F.flatten(F.transform(t["p"], lambda y: F.transform(t["p"], lambda x: t["f"].bitwiseOR(left(x.bitwiseOR(F.shiftleft(y, 1)), t["u"]))))))
    return F.when(inside, found)


def sibling(cell) -> Column:
    """The children of the parent, the cell among them; of the root, its children."""
    c = long(cell)
    return to_children(to_parent(c))


#: The places of x in the bits of x and y in turn.
X_PLACES = 0x5555555555555555


def stepped(pairs: Column, places: int, by: Column | int) -> Column:
    """The bits of x or y among the bits in turn, moved by so many tiles; beyond the grid bits stand outside the map's.

    Adding carries over the other one's bits where they are ones, taking away does where they are zeros.
    """
    own = F.lit(places - (1 << 64) if places >> 63 else places)
    y = places != X_PLACES
    mine = pairs.bitwiseAND(own)
    if isinstance(by, int):
        step = sum((abs(by) >> i & 1) << 2 * i + y for i in range(27))
        return (mine.bitwiseOR(F.bitwise_not(own)) + F.lit(step)).bitwiseAND(own) if by > 0 else (mine - F.lit(step)).bitwiseAND(own) if by else mine
    step = F.shiftleft(spread_bits(F.abs(by)), int(y))
    return F.when(by >= 0, (mine.bitwiseOR(F.bitwise_not(own)) + step).bitwiseAND(own)).otherwise((mine - step).bitwiseAND(own))


def kring(cell, k) -> Column:
    """Cells at most k steps away in x and y, row by row; the map's edges are not crossed.

    Columns and rows are moved once each, among the bits in turn; a cell is then made of a column and a row by two operations.
    """
    c = long(cell)
    pairs, z = pairs_of(c), zoom(c)
    known = isinstance(k, int) and 0 <= k <= 16  # a constant's steps are constants
    size = k if known else None
    k = long(k)

    def around(t: Column) -> Column:
        def moved(places: int) -> Column:
            if size is not None:
                each = F.array(*[stepped(t["p"], places, d) for d in range(-size, size + 1)])
            else:
                each = F.transform(F.sequence(-t["k"], t["k"]), lambda d: stepped(t["p"], places, d))
            shifted = F.transform(F.filter(each, lambda p: right(p, t["w"]) == 0), lambda p: left(p, t["u"]))
            return shifted

        made = F.struct(moved(X_PLACES).alias("x"), F.transform(moved(X_PLACES << 1), lambda y: y.bitwiseOR(t["h"])).alias("y"))
        return let(made, lambda m: F.flatten(F.transform(m["y"], lambda y: F.transform(m["x"], lambda x: y.bitwiseOR(x)))))

    # no more steps than the grid is wide
    bounded = F.least(F.greatest(k, F.lit(0).cast("bigint")), grid(z))
    head = c.bitwiseAND(F.lit(~FOOTER)).bitwiseOR(right(F.lit(FOOTER), 2 * z))
    found = let(F.struct(pairs.alias("p"), (2 * z).alias("w"), (52 - 2 * z).alias("u"), head.alias("h"), bounded.alias("k")), around)
    return F.when(c.isNull() | k.isNull(), F.lit(None).cast("array<bigint>")).when(k < 0, F.array().cast("array<bigint>")).otherwise(found)


def edges(x: Column, y: Column, z: Column) -> dict[str, Column]:
    """West, south, east and north of a tile in degrees."""
    return {"west": lon_at(x, z), "south": lat_at(y + 1, z), "east": lon_at(x + 1, z), "north": lat_at(y, z)}


def bounds(c: Column) -> dict[str, Column]:
    """West, south, east and north of a cell in degrees."""
    return edges(tile_x(c), tile_y(c), zoom(c))


def named(c: Column, values, names) -> Column:
    return F.when(c.isNotNull(), F.struct(*[v.alias(n) for v, n in zip(values, names, strict=True)]))


def to_bbox(cell, ignored=None) -> Column:
    """STRUCT(min_lon, min_lat, max_lon, max_lat) in degrees."""
    c = long(cell)
    return named(c, bounds(c).values(), ("min_lon", "min_lat", "max_lon", "max_lat"))


def metres(c: Column) -> list[Column]:
    z, x, y = zoom(c), tile_x(c), tile_y(c)
    half = math.pi * EARTH_RADIUS
    size = 2.0 * half / side(z)
    return [x * size - half, half - (y + 1) * size, (x + 1) * size - half, half - y * size]


CORNERS = ("min_x", "min_y", "max_x", "max_y")


def to_bbox_mercator(cell, ignored=None) -> Column:
    """STRUCT(min_x, min_y, max_x, max_y) in metres of EPSG:3857."""
    c = long(cell)
    return named(c, metres(c), CORNERS)


def to_bbox_wgs84(cell, ignored=None, compat: bool = False) -> Column:
    """STRUCT(min_x, min_y, max_x, max_y) in degrees; ``compat``: in metres, as the original returns."""
    c = long(cell)
    return named(c, metres(c) if compat else bounds(c).values(), CORNERS)


def plain_number(v: Column) -> Column:
    """Shortest decimal text without an exponent or an empty fraction."""
    text = F.when(F.abs(v) < 1e-3, v.cast("decimal(38,28)").cast("string")).otherwise(v.cast("string"))
    return F.regexp_replace(F.regexp_replace(text, r"(\.\d*?)0+$", "$1"), r"\.$", "")


def let(value: Column, use) -> Column:
    """``use(value)``, the value computed once however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


#: The ring of a box, from its south-west corner.
RING = (("west", "south"), ("east", "south"), ("east", "north"), ("west", "north"), ("west", "south"))


def with_edges(c: Column, use) -> Column:
    """``use`` of a struct of a cell's edges, each computed once."""
    tile = F.struct(tile_x(c).alias("x"), tile_y(c).alias("y"), zoom(c).alias("z"))
    return let(tile, lambda t: let(F.struct(*[v.alias(n) for n, v in edges(t["x"], t["y"], t["z"]).items()]), use))


def to_wkt(cell) -> Column:
    """The cell's bounds as a POLYGON."""
    c = long(cell)

    def text(t: Column) -> Column:
        return F.concat(F.lit("POLYGON(("), F.concat_ws(",", *[F.concat_ws(" ", t[x], t[y]) for x, y in RING]), F.lit("))"))

    written = with_edges(c, lambda e: let(F.struct(*[plain_number(e[n]).alias(n) for n in ("west", "south", "east", "north")]), text))
    return F.when(c.isNotNull(), written)


def to_geojson(cell) -> Column:
    """The cell's bounds as a GeoJSON geometry."""
    c = long(cell)

    def text(e: Column) -> Column:
        return F.to_json(F.struct(F.lit("Polygon").alias("type"), F.array(F.array(*[F.array(e[x], e[y]) for x, y in RING])).alias("coordinates")))

    return F.when(c.isNotNull(), with_edges(c, text))


def pixel_xy(lon, lat, resolution, tile_size) -> Column:
    """STRUCT(pixel_x, pixel_y) of a point in its tile."""
    lon, lat, z, size = col(lon).cast("double"), col(lat).cast("double"), long(resolution), long(tile_size)
    out = []
    for v in ((lon + 180.0) / 360.0 * side(z), mercator_fraction(lat) * side(z)):
        inside = (v - F.floor(v)) * size
        out.append(F.greatest(F.lit(0.0), F.when(inside >= size, (size - 1).cast("double")).otherwise(inside)).cast("int"))
    return F.when(valid_zoom(z) & (size > 0) & located(lon, lat), F.struct(out[0].alias("pixel_x"), out[1].alias("pixel_y")))


def bbox_cells(min_lon, min_lat, max_lon, max_lat, resolution) -> Column:
    """All cells of a box in degrees, border tiles included, column by column."""
    z = long(resolution)
    box = [col(v).cast("double") for v in (min_lon, min_lat, max_lon, max_lat)]
    (x0, y0), (x1, y1) = tile_at(box[0], box[3], z), tile_at(box[2], box[1], z)
    box_ok = valid_zoom(z) & located(box[0], box[3]) & located(box[2], box[1]) & (box[0] <= box[2]) & (box[1] <= box[3])
    head = F.lit(HEADER | MODE).bitwiseOR(F.shiftleft(z, 52)).bitwiseOR(right(F.lit(FOOTER), 2 * z))
    parts = F.struct(F.transform(F.sequence(x0, x1), spread_bits).alias("x"), F.transform(F.sequence(y0, y1), spread_bits).alias("y"), head.alias("h"), (52 - 2 * z).alias("u"))
    found = let(parts, lambda t: F.flatten(F.transform(t["x"], lambda i: F.transform(t["y"], lambda j: t["h"].bitwiseOR(left(i.bitwiseOR(F.shiftleft(j, 1)), t["u"]))))))
    return F.when(box_ok, found)


def descendants(cell, resolution) -> tuple[Column, Column]:
    """First and last cell at a zoom inside a cell: all between them at that zoom are inside, so a range finds them."""
    c, r = long(cell), long(resolution)
    first = at_zoom(c.bitwiseAND(F.bitwise_not(right(F.lit(FOOTER), 2 * zoom(c)))), r)
    count = left(F.lit(1).cast("bigint"), 2 * (r - zoom(c))) - 1
    inside = (r >= zoom(c)) & (r <= MAX_RESOLUTION)
    return F.when(inside, first), F.when(inside, first + left(count, 52 - 2 * r))


def to_corner(cell) -> Column:
    """STRUCT(lon, lat) of the cell's north-west corner."""
    c = long(cell)
    z = zoom(c)
    return F.when(c.isNotNull(), F.struct(lon_at(tile_x(c), z).alias("lon"), lat_at(tile_y(c), z).alias("lat")))


def is_tile(x, y, z) -> Column:
    """Whether a zoom exists and the tile lies in its grid."""
    x, y, z = long(x), long(y), long(z)
    return F.coalesce(valid_zoom(z) & (x >= 0) & (y >= 0) & (x < grid(z)) & (y < grid(z)), F.lit(False))


def is_cell(cell) -> Column:
    """Whether a number is a cell: header, mode, a zoom, and ones below its bits."""
    c = long(cell)
    rest = right(F.lit(FOOTER), 2 * zoom(c))
    marked = c.bitwiseAND(F.lit(-(1 << 59))) == F.lit(HEADER | MODE)
    middle = c.bitwiseAND(F.lit(3 << 57)) == 0
    return F.coalesce(marked & middle & valid_zoom(zoom(c)) & (c.bitwiseAND(rest) == rest), F.lit(False))


def lon_to_x(lon) -> Column:
    """Metres east in EPSG:3857."""
    return radians(col(lon).cast("double")) * EARTH_RADIUS


def lat_to_y(lat) -> Column:
    """Metres north in EPSG:3857."""
    return F.ln(F.tan(math.pi / 4.0 + radians(col(lat).cast("double")) / 2.0)) * EARTH_RADIUS


def x_to_lon(x) -> Column:
    """Degrees of metres east."""
    return F.degrees(col(x).cast("double") / EARTH_RADIUS)


def y_to_lat(y) -> Column:
    """Degrees of metres north."""
    return F.degrees(2.0 * F.atan(F.exp(col(y).cast("double") / EARTH_RADIUS)) - math.pi / 2.0)
