"""Geometries given as well-known text, and the cells they cover.

Vertices are first moved to whole tiles. Inside a polygon, a tile counts if its centre line is crossed an odd number of times
before its middle (the scan-line rule of the public GDAL rasterizer); along borders, every tile that the line passes counts
(its all-touched rule). The grid is half-open: it ends before the largest tile column and row, so that neighbours that share
a border do not share tiles. A grid without width or height is given one tile of it. ``cover=True`` keeps the last ones.
"""

from __future__ import annotations

import math
import re
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tilewright.errors import GeometryError
from tilewright.functions import cells, metadata

Point = tuple[float, float]
Ring = list[Point]

_token = re.compile(r"\s*([A-Za-z]+|[-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?|[(),])")
#: Shifts and masks that move the bits of a number to the even places.
SPREAD = ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555))


class _Reader:
    """Well-known text, word by word."""

    def __init__(self, text: str):
        self.words, at = [], 0
        text = text.strip()
        while at < len(text):
            m = _token.match(text, at)
            if not m:
                raise GeometryError(f"bad text at {at}: {text[at : at + 20]!r}")
            self.words.append(m[1])
            at = m.end()
        self.at = 0

    def peek(self) -> str:
        return self.words[self.at] if self.at < len(self.words) else ""

    def take(self, wanted: str | None = None) -> str:
        word = self.peek()
        if not word or wanted is not None and word != wanted:
            raise GeometryError(f"expected {wanted or 'more'}, found {word or 'the end'}")
        self.at += 1
        return word

    def listed(self, item):
        if self.peek().upper() == "EMPTY":
            self.take()
            return []
        self.take("(")
        out = [item()]
        while self.peek() == ",":
            self.take()
            out.append(item())
        self.take(")")
        return out

    def coordinates(self) -> Point:
        numbers = []
        while self.peek() not in ("", ",", "(", ")"):
            try:
                numbers.append(float(self.take()))
            except ValueError as e:
                raise GeometryError(str(e)) from e
        if not 2 <= len(numbers) <= 4:
            raise GeometryError("a point needs two numbers")
        return numbers[0], numbers[1]

    def ring(self) -> Ring:
        return self.listed(self.coordinates)

    def point(self) -> Point:
        if self.peek() == "(":
            self.take()
            p = self.coordinates()
            self.take(")")
            return p
        return self.coordinates()

    def geometry(self) -> list[tuple[str, object]]:
        """Simple parts: ('POINT', p), ('LINESTRING', ring) or ('POLYGON', rings)."""
        kind = self.take().upper()
        if self.peek().upper() in ("Z", "M", "ZM"):
            self.take()
        if kind == "GEOMETRYCOLLECTION":
            return [part for g in self.listed(self.geometry) for part in g]
        single, parts = {
            "POINT": ("POINT", lambda: self.listed(self.coordinates)),
            "MULTIPOINT": ("POINT", lambda: self.listed(self.point)),
            "LINESTRING": ("LINESTRING", lambda: [self.ring()]),
            "MULTILINESTRING": ("LINESTRING", lambda: self.listed(self.ring)),
            "POLYGON": ("POLYGON", lambda: [self.listed(self.ring)]),
            "MULTIPOLYGON": ("POLYGON", lambda: self.listed(lambda: self.listed(self.ring))),
        }.get(kind, (None, None))
        if single is None:
            raise GeometryError(f"unknown geometry {kind}")
        return [(single, x) for x in parts() if x]


def parse(text: str) -> list[tuple[str, object]]:
    """The simple parts of a well-known text."""
    reader = _Reader(text)
    parts = reader.geometry()
    if reader.peek():
        raise GeometryError(f"text goes on after the geometry: {reader.peek()}")
    return parts


def tile_of(p: Point, z: int, compat: bool = False) -> tuple[int, int]:
    """The tile of a point, clamped to the map."""
    n = 1 << z
    lat = min(max(p[1], -cells.MAX_LATITUDE), cells.MAX_LATITUDE)
    x = math.floor((p[0] + 180.0) / 360.0 * n)
    y = math.floor((1.0 - math.asinh(math.tan(lat * math.pi / 180.0)) / math.pi) / 2.0 * n)
    last = min(n, 127) - 1 if compat else n - 1
    return tuple(last if v >= n else max(v, 0) for v in (x, y))


Cells = tuple[np.ndarray, np.ndarray]
#: Cells of many geometries: (geometry, x, y).
Owned = tuple[np.ndarray, np.ndarray, np.ndarray]


def spread_runs(first: np.ndarray, after: np.ndarray) -> Cells:
    """Of runs of whole numbers: the run's place and the number, for each number from ``first`` to before ``after``."""
    n = np.maximum(after - first, 0)
    run = np.repeat(np.arange(len(n)), n)
    return run, np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + first[run]


def line_runs(ends: np.ndarray, width, height, low, high) -> Owned:
    """Cells (side, x, y) of grids on straight lines, given as rows (x0, y0, x1, y1), within some rows of the grid; grids and
    rows are the same for all lines, or arrays.

    A cell is on a slanted line if the line, without its eastern end, has a point that lies in the cell, on its northern or
    on its western side. So the line's heights at the sides of a column tell the rows that it takes there, for all columns
    at once, and exactly for whole coordinates. Upright and level lines take both their ends, kept within the grid.
    """
    width, height, low, high = (np.broadcast_to(np.asarray(v, np.int64), len(ends)) for v in (width, height, np.maximum(low, 0), np.minimum(high, height)))
    west = np.where((ends[:, 0] <= ends[:, 2])[:, None], ends, ends[:, [2, 3, 0, 1]])
    near = (np.maximum(ends[:, 1], ends[:, 3]) >= 0) & (np.minimum(ends[:, 1], ends[:, 3]) <= height) & (west[:, 2] >= 0) & (west[:, 0] <= width)
    line = np.flatnonzero(near)
    west, width, height, low, high = (v[line] for v in (west, width, height, low, high))
    x0, y0, x1, y1 = west.T
    upright = np.floor(x0) == np.floor(x1)
    level = ~upright & (np.floor(y0) == np.floor(y1))
    a, b = (np.clip(np.floor(v), 0, height - 1).astype(np.int64) for v in (np.minimum(y0, y1), np.maximum(y0, y1)))
    column = np.floor(x1).astype(np.int64)
    at = np.flatnonzero(upright & (column >= 0) & (column < width))
    run, y = spread_runs(np.maximum(a, low)[at], np.minimum(b + 1, high)[at])
    owners, xs, ys = [at[run]], [column[at][run]], [y]
    a, b = (np.clip(np.floor(v), 0, width - 1).astype(np.int64) for v in (x0, x1))
    row = np.floor(y0).astype(np.int64)
    at = np.flatnonzero(level & (row >= low) & (row < high))
    run, x = spread_runs(a[at], b[at] + 1)
    owners, xs, ys = [*owners, at[run]], [*xs, x], [*ys, row[at][run]]
    at = np.flatnonzero(~upright & ~level)
    x0, y0, x1, y1 = west[at].T
    low, high = low[at], high[at]
    dx, dy = x1 - x0, y1 - y0
    # columns whose heights can fall into the wanted rows
    reach = np.sort(np.stack([(low - 1 - y0) / dy * dx + x0, (high + 1 - y0) / dy * dx + x0]), axis=0)
    first = np.floor(np.maximum(np.maximum(x0, 0), reach[0] - 1)).astype(np.int64)
    after = np.ceil(np.minimum(np.minimum(x1, width[at]), reach[1] + 1)).astype(np.int64)
    run, column = spread_runs(first, after)
    height_at = lambda x: (y0[run] * dx[run] + (x - x0[run]) * dy[run]) / dx[run]
    here, there = height_at(np.maximum(column, x0[run])), height_at(np.minimum(column + 1, x1[run]))
    down = there > here  # rows grow to the south; the far side itself is not taken
    top = np.floor(np.where(down, here, there)).astype(np.int64)
    bottom = np.where(down, np.ceil(there) - 1, np.floor(here)).astype(np.int64)
    part, y = spread_runs(np.maximum(top, low[run]), np.minimum(np.maximum(bottom, top) + 1, high[run]))
    return line[np.concatenate([*owners, at[run[part]]])], np.concatenate([*xs, column[part]]), np.concatenate([*ys, y])


def line_cells(ends: np.ndarray, width: int, height: int, rows: tuple[int, int] | None = None) -> Cells:
    """Cells (x, y) of a grid on straight lines, given as rows (x0, y0, x1, y1), within some rows of the grid."""
    return line_runs(ends, width, height, *(rows or (0, height)))[1:]


def sides(rings: list[Ring]) -> np.ndarray:
    """The sides (x0, y0, x1, y1) of rings, which are closed where they are not."""
    closed = [r if r[0] == r[-1] else [*r, r[0]] for r in rings if r]
    return np.array([(*a, *b) for r in closed for a, b in zip(r, r[1:], strict=False)], np.float64).reshape(-1, 4)


def inside_runs(edges: np.ndarray, owner: np.ndarray, width, low, high) -> Owned:
    """Cells (polygon, x, y) between the sides of polygons; ``owner`` is a side's polygon, all else is one for each side."""
    sloped = np.flatnonzero(edges[:, 1] != edges[:, 3])
    edges = edges[sloped]
    x0, y0, x1, y1 = np.where((edges[:, 1] < edges[:, 3])[:, None], edges, edges[:, [2, 3, 0, 1]]).T
    first, after = (np.clip(np.ceil(v - 0.5), low[sloped], high[sloped]).astype(np.int64) for v in (y0, y1))
    run, row = spread_runs(first, after)
    crossed = np.floor((row + 0.5 - y0[run]) * (x1 - x0)[run] / (y1 - y0)[run] + x0[run] + 0.5).astype(np.int64)
    crossed, of = np.clip(crossed, 0, width[sloped][run]), owner[sloped][run]
    order = np.lexsort([crossed, row, of])  # a row is crossed an even number of times: inside is between odd and even ones
    row, crossed, of = row[order], crossed[order], of[order]
    run, x = spread_runs(crossed[::2], crossed[1::2])
    return of[::2][run], x, row[::2][run]


def polygon_cells(rings: list[Ring], width: int, height: int, rows: tuple[int, int] | None = None) -> Cells:
    """Cells (x, y) of a grid inside or on the border of a polygon, within some rows of the grid; a cell may come twice."""
    low, high = rows or (0, height)
    low, high = max(low, 0), min(high, height)
    edges = sides(rings)
    _, x, y = inside_runs(edges, np.zeros(len(edges), np.int64), *(np.full(len(edges), v) for v in (width, low, high)))
    bx, by = line_cells(edges, width, height, (low, high))
    return np.concatenate([x, bx]), np.concatenate([y, by])


def distinct(x: np.ndarray, y: np.ndarray, width: int) -> Cells:
    """Each cell once, row by row."""
    y, x = np.divmod(np.unique(y * width + x), width)
    return x, y


class Placed:
    """A simple part of a geometry on the grid of its own tiles."""

    def __init__(self, kind: str, part, z: int, cover: bool = False, compat: bool = False):
        self.kind = kind
        rings = [[part]] if kind == "POINT" else part if kind == "POLYGON" else [part]
        rings = [[tile_of(p, z, compat) for p in r] for r in rings]
        xs, ys = ([p[i] for r in rings for p in r] for i in (0, 1))
        self.x, self.y = min(xs), min(ys)
        self.width, self.height = (max(v) - min(v) + cover or 1 for v in (xs, ys))
        self.rings = [[(x - self.x, y - self.y) for x, y in r] for r in rings]

    def cells(self, first: int, after: int) -> Cells:
        """Tiles of the part in some rows of the map."""
        rows = first - self.y, after - self.y
        if self.kind == "POLYGON":
            x, y = polygon_cells(self.rings, self.width, self.height, rows)
        elif self.kind == "POINT" or len(self.rings[0]) < 2 or len(set(self.rings[0])) == 1:
            x = y = np.zeros(1 if rows[0] <= 0 < rows[1] else 0, np.int64)
        else:
            (ring,) = self.rings
            x, y = line_cells(np.array([(*a, *b) for a, b in zip(ring, ring[1:], strict=False)], np.float64), self.width, self.height, rows)
        return x + self.x, y + self.y


def placed(wkt: str, z: int, cover: bool = False, compat: bool = False) -> list[Placed]:
    if not 0 <= z <= cells.MAX_RESOLUTION:
        raise GeometryError(f"zoom {z} is outside 0..{cells.MAX_RESOLUTION}")
    return [Placed(kind, part, z, cover, compat) for kind, part in parse(wkt)]


def polyfill_rows(parts: list[Placed], z: int, first: int, after: int) -> np.ndarray:
    """Cells of a geometry's parts in some rows of the map, row by row."""
    found = [p.cells(first, after) for p in parts if p.y < after and p.y + p.height > first]
    if not found:
        return np.zeros(0, np.int64)
    x, y = (np.concatenate(v) for v in zip(*found, strict=True))
    return encode_tiles(*distinct(x, y, 1 << z), z)


def polyfill_cells(wkt: str, z: int, cover: bool = False, compat: bool = False) -> np.ndarray:
    """Cells of a geometry at a zoom, row by row."""
    return polyfill_rows(placed(wkt, z, cover, compat), z, 0, 1 << z)


def polyfill_tiles(wkt: str, z: int, cover: bool = False, compat: bool = False) -> list[tuple[int, int]]:
    """Tiles of a geometry at a zoom, row by row."""
    found = [p.cells(0, 1 << z) for p in placed(wkt, z, cover, compat)]
    if not found:
        return []
    x, y = distinct(*(np.concatenate(v) for v in zip(*found, strict=True)), 1 << z)
    return list(zip(x.tolist(), y.tolist(), strict=True))


#: Texts of one polygon or line of plain numbers, two to a vertex, whose vertices are read for a whole batch at once.
NUMBER = r"-?(?:\d+(?:\.\d*)?|\.\d+)(?:[eE][-+]?\d{1,2})?"
VERTEX = rf"\s*{NUMBER}\s+{NUMBER}\s*"
VERTICES = rf"\s*\({VERTEX}(?:,{VERTEX})*\)\s*"
PLAIN = rf"^\s*(?:LINESTRING{VERTICES}|POLYGON\s*\({VERTICES}(?:,{VERTICES})*\)\s*)$"
POINTS, LINE, AREA = range(3)
#: Cells, by an upper bound, that geometries are made into at once; one that has more is made alone.
CHUNK_CELLS = 1 << 21


class Vertices:
    """Vertices of the simple parts of many geometries, part by part: ``part`` and ``ring`` of each, ``row`` and ``kind`` of each part."""

    def __init__(self, texts: pa.Array, rows: np.ndarray):
        """Vertices of texts, whose numbers are ``rows``."""
        plain = np.asarray(pc.match_substring_regex(texts, PLAIN).to_numpy(zero_copy_only=False), bool)
        read = self.plain(texts.filter(pa.array(plain)))
        other = self.parsed(texts.filter(pa.array(~plain)))
        self.row = np.concatenate([rows[plain], rows[~plain][other[0]]])
        self.kind = np.concatenate([read[0], other[1]])
        self.part = np.concatenate([read[1], other[2] + len(read[0])])
        self.ring = np.concatenate([read[2], other[3] + (read[2][-1] + 1 if len(read[2]) else 0)])
        self.lon, self.lat = (np.concatenate([read[i], other[i + 1]]) for i in (3, 4))
        if not np.isfinite(self.lon).all():
            raise GeometryError("a longitude is not finite")

    @staticmethod
    def plain(texts: pa.Array) -> tuple[np.ndarray, ...]:
        """(kind of each part; part, ring, longitude, latitude of each vertex) of plain texts: their bytes are told apart as arrays."""
        texts = texts.cast(pa.large_string())
        starts = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset :][: len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
        raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[: starts[-1]]
        figure = (raw >= 48) & (raw <= 57) | (raw == 46) | (raw == 45) | (raw == 43)  # 0-9 . - +
        power = (raw | 32) == 101  # e, E: of a number only after a figure
        power[1:] &= figure[:-1]
        at = np.flatnonzero(figure | power)
        first = np.flatnonzero(np.diff(at, prepend=-2) != 1)
        ends = np.concatenate([first, [len(at)]]).astype(np.int64)
        numbers = pa.LargeStringArray.from_buffers(len(first), pa.py_buffer(ends), pa.py_buffer(raw[at])).cast(pa.float64()).to_numpy()
        vertex = at[first[::2]]
        kind = np.where(pc.match_substring(texts, "POLYGON").to_numpy(zero_copy_only=False), AREA, LINE)
        return kind, np.searchsorted(starts, vertex, "right") - 1, np.cumsum(raw == 40)[vertex], numbers[::2], numbers[1::2]

    @staticmethod
    def parsed(texts: pa.Array) -> tuple[np.ndarray, ...]:
        """(text, kind of each part; part, ring, longitude, latitude of each vertex) of any texts, read one by one."""
        parts, vertices, ring = [], [], 0
        for i, text in enumerate(texts.to_pylist()):
            for kind, body in parse(text):
                rings = [r for r in ([[body]] if kind == "POINT" else body if kind == "POLYGON" else [body]) if r]
                if rings:
                    vertices += [(len(parts), ring + j, *p) for j, r in enumerate(rings) for p in r]
                    parts.append((i, {"POINT": POINTS, "LINESTRING": LINE, "POLYGON": AREA}[kind]))
                    ring += len(rings)
        text, kind = np.array(parts, np.int64).reshape(-1, 2).T
        part, ring, lon, lat = np.array(vertices, np.float64).reshape(-1, 4).T
        return text, kind, part.astype(np.int64), ring.astype(np.int64), lon, lat


def tiles_of(lon: np.ndarray, lat: np.ndarray, z: np.ndarray, compat: bool = False) -> Cells:
    """The tiles of points, the same as ``tile_of`` gives one by one."""
    n = np.left_shift(1, z)
    x = np.floor((lon + 180.0) / 360.0 * n)
    height = (1.0 - np.arcsinh(np.tan(np.clip(lat, -cells.MAX_LATITUDE, cells.MAX_LATITUDE) * math.pi / 180.0)) / math.pi) / 2.0 * n
    last = (np.minimum(n, 127) if compat else n) - 1
    x, y = (np.where(v >= n, last, np.maximum(v, 0)).astype(np.int64) for v in (x, np.floor(height)))
    # numpy's tangent may differ in its last digits, which tell beside a tile's edge
    for i in np.flatnonzero(np.abs(height - np.rint(height)) < 1e-6).tolist():
        y[i] = tile_of((0.0, float(lat[i])), int(z[i]), compat)[1]
    return x, y


def polyfill_batch(texts: pa.Array, zooms: np.ndarray, cover: bool = False, compat: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(sizes, cells): how many cells each geometry has at its zoom, and all of them, row by row."""
    found = Vertices(texts, np.arange(len(texts)))
    sizes = np.zeros(len(texts), np.int64)
    if not len(found.part):
        return sizes, np.zeros(0, np.int64)
    row, kind, part = found.row, found.kind, found.part
    vx, vy = tiles_of(found.lon, found.lat, zooms[row][part], compat)
    first = np.flatnonzero(np.diff(part, prepend=-1))  # every part has vertices
    x, y = np.minimum.reduceat(vx, first), np.minimum.reduceat(vy, first)
    width, height = (np.maximum(np.maximum.reduceat(v, first) - low + cover, 1) for v, low in ((vx, x), (vy, y)))
    kind = np.where((kind == LINE) & (np.maximum.reduceat(vx, first) == x) & (np.maximum.reduceat(vy, first) == y), POINTS, kind)
    # sides: from each vertex to the next of its ring, and from the last to the first of a ring that is not closed
    begins = np.flatnonzero(np.diff(found.ring, prepend=found.ring[0] - 1))
    ends = np.concatenate([begins[1:], [len(part)]]) - 1
    inner = np.ones(len(part), bool)
    inner[ends] = False
    a = np.flatnonzero(inner)
    open_ = (kind[part[ends]] == AREA) & ((vx[begins] != vx[ends]) | (vy[begins] != vy[ends]))
    a, b = np.concatenate([a, ends[open_]]), np.concatenate([a + 1, begins[open_]])
    owner = part[a]
    drawn = kind[owner] != POINTS
    a, b, owner = a[drawn], b[drawn], owner[drawn]
    sides = np.stack([vx[a] - x[owner], vy[a] - y[owner], vx[b] - x[owner], vy[b] - y[owner]], axis=1)
    # the box of each geometry, and an upper bound of its cells
    west, north = (np.full(len(texts), 1 << cells.MAX_RESOLUTION, np.int64) for _ in range(2))
    east, south = (np.zeros(len(texts), np.int64) for _ in range(2))
    np.minimum.at(west, row, x), np.minimum.at(north, row, y), np.maximum.at(east, row, x + width), np.maximum.at(south, row, y + height)
    most = np.zeros(len(texts))
    np.add.at(most, row, np.where(kind == AREA, width * 1.0 * height, 1.0))
    np.add.at(most, row[owner], np.abs(sides[:, 2] - sides[:, 0]) + np.abs(sides[:, 3] - sides[:, 1]) + 1.0)
    most += np.where(east > 0, east - west + south - north, 0)
    chunk = np.zeros(len(texts), np.int64)
    if most.sum() > CHUNK_CELLS:
        room = 0.0
        for i, m in enumerate(most.tolist()):
            room += m
            if i and room > CHUNK_CELLS:
                chunk[i], room = 1, m
        chunk = np.cumsum(chunk)
    out = []
    for c in range(int(chunk[-1]) + 1):
        mine, lines = chunk[row] == c, chunk[row[owner]] == c
        of, ends = owner[lines], sides[lines].astype(np.float64)
        filled = kind[of] == AREA
        line, lx, ly = line_runs(ends, width[of], height[of], 0, height[of])
        area, ax, ay = inside_runs(ends[filled], of[filled], width[of][filled], np.zeros(filled.sum(), np.int64), height[of][filled])
        single = np.flatnonzero(mine & (kind == POINTS))
        p = np.concatenate([of[line], area, single])
        px = np.concatenate([lx, ax, np.zeros(len(single), np.int64)]) + x[p]
        py = np.concatenate([ly, ay, np.zeros(len(single), np.int64)]) + y[p]
        # one number for a cell of a geometry, in the order of geometries, rows and columns
        has = np.flatnonzero((chunk == c) & (east > 0))
        if not len(has):
            continue
        base = np.cumsum((south - north)[has]) - (south - north)[has]
        offset, across = np.zeros(len(texts), np.int64), int((east - west)[has].max())
        offset[has] = base
        r = row[p]
        keys = np.unique((offset[r] + py - north[r]) * across + px - west[r])
        line, column = np.divmod(keys, across)
        r = has[np.searchsorted(base, line, "right") - 1]
        sizes += np.bincount(r, minlength=len(texts))
        out.append(encode_tiles(column + west[r], line - offset[r] + north[r], zooms[r]))
    return sizes, np.concatenate(out or [np.zeros(0, np.int64)])


def tile_extent(wkt: str, z: int) -> tuple[int, int, int, int]:
    """First and last tile column and row of a geometry's box: (min_x, min_y, max_x, max_y)."""
    points = [p for kind, part in parse(wkt) for p in ([part] if kind == "POINT" else part if kind == "LINESTRING" else [p for r in part for p in r])]
    if not points:
        raise GeometryError("an empty geometry has no extent")
    lons, lats = zip(*points, strict=True)
    (x0, y0), (x1, y1) = tile_of((min(lons), max(lats)), z), tile_of((max(lons), min(lats)), z)
    return x0, y0, x1, y1


def encode_tile(x: int, y: int, z: int) -> int:
    """The cell of a tile, in plain Python for the driver and for Arrow functions."""
    if not (0 <= z <= cells.MAX_RESOLUTION and 0 <= x < 1 << z and 0 <= y < 1 << z):
        raise GeometryError(f"no tile {x}, {y} at zoom {z}")
    pairs = 0
    for i in range(z):
        pairs |= (x >> i & 1) << 2 * i | (y >> i & 1) << 2 * i + 1
    return cells.HEADER | cells.MODE | z << 52 | pairs << 52 - 2 * z | cells.FOOTER >> 2 * z


def encode_tiles(x: np.ndarray, y: np.ndarray, z: int | np.ndarray) -> np.ndarray:
    """The cells of tiles of a zoom's grid, or each of its own zoom's."""
    pairs = np.zeros(len(x), np.int64)
    for place, v in ((0, x), (1, y)):
        v = v.astype(np.int64)
        for shift, mask in SPREAD:
            v = (v | v << shift) & mask
        pairs |= v << place
    return cells.HEADER | cells.MODE | z << 52 | pairs << 52 - 2 * z | cells.FOOTER >> 2 * z


def polyfill_list(wkt: str, z: int, cover: bool = False, compat: bool = False) -> list[int]:
    """Cells of a geometry at a zoom, row by row: for constants, on the driver."""
    return polyfill_cells(wkt, z, cover, compat).tolist()


@cache
def polyfill_udf(cover: bool = False, compat: bool = False):
    @F.arrow_udf("array<bigint>")
    def polyfill_shapes(texts: pa.Array, zooms: pa.Array) -> pa.Array:
        z = pc.fill_null(zooms, -1).to_numpy(zero_copy_only=False).astype(np.int64)
        there = (z >= 0) & (z <= cells.MAX_RESOLUTION) & texts.is_valid().to_numpy(zero_copy_only=False)
        sizes = np.zeros(len(texts), np.int64)
        sizes[there], found = polyfill_batch(texts.filter(pa.array(there)), z[there], cover, compat)
        at = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32), pa.int32(), mask=np.concatenate([~there, [False]]))
        return pa.ListArray.from_arrays(at, pa.array(found, pa.int64()))

    return polyfill_shapes


#: Cells that one row of a frame of cells is made into at once.
BAND_CELLS = 1 << 16


def polyfill_frame(spark: SparkSession, wkt: str, z: int, cover: bool = False, compat: bool = False) -> DataFrame:
    """(block): the cells of one geometry, made by tasks in bands of rows; the driver never holds them."""
    parts = placed(wkt, z, cover, compat)
    if not parts:
        return spark.createDataFrame([], "block bigint")
    top, bottom = min(p.y for p in parts), max(p.y + p.height for p in parts)
    band = max(1, BAND_CELLS // max(p.width for p in parts))
    starts = spark.range(top, bottom, band, numPartitions=max(1, min(1 << 12, (bottom - top) // band)))

    def fill(batches):
        own = placed(wkt, z, cover, compat)
        for batch in batches:
            for first in batch.column(0).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(polyfill_rows(own, z, first, min(first + band, bottom)), pa.int64())], ["block"])

    return starts.mapInArrow(fill, "block bigint")


def most_cells(wkt: str, z: int, cover: bool = False) -> int:
    """More cells than this a geometry does not have."""
    return sum(p.width * p.height for p in placed(wkt, z, cover))


def range_of(wkt: str, z: int, cover: bool = False) -> tuple[int, int]:
    """Numbers between which all cells of a geometry are: those of its box's first and last tile."""
    parts = placed(wkt, z, cover)
    last = (1 << z) - 1
    x = np.array([min(p.x for p in parts), min(last, max(p.x + p.width - 1 for p in parts))])
    y = np.array([min(p.y for p in parts), min(last, max(p.y + p.height - 1 for p in parts))])
    return tuple(encode_tiles(x, y, z).tolist())


def is_point(text: Column) -> Column:
    from tilewright.functions.bands import POINT

    return F.coalesce(text.rlike(POINT), F.lit(False))


def polyfill(wkt: Column | str, resolution, cover: bool = False, compat: bool = False) -> Column:
    """ARRAY<BIGINT>: cells of a geometry. Points never leave the JVM."""
    text = metadata.as_column(wkt)
    z = cells.long(resolution)
    from tilewright.functions.bands import point

    lon, lat = point(text)
    at = cells.let(F.struct(lon.alias("lon"), lat.alias("lat"), z.alias("z")), lambda p: cells.from_lonlat(p["lon"], p["lat"], p["z"], compat))
    other = polyfill_udf(cover, compat)(F.when(~is_point(text), text), z)
    return F.when(is_point(text), F.when(at.isNotNull(), F.array(at))).otherwise(other)


def intersects(wkt: Column | str, document: Column | str, cover: bool = False, compat: bool = False) -> Column:
    """ARRAY<BIGINT>: cells of a geometry at the document's finest zoom."""
    return polyfill(wkt, metadata.quadbin_metadata(document)["max_zoom"], cover, compat)
