"""Cells of a whole batch of geometries, made at once, against those of each geometry by itself."""

import random

import numpy as np
import pyarrow as pa
import pytest

from tilewright.errors import GeometryError
from tilewright.functions import geometry

pytestmark = pytest.mark.usefixtures("spark")
rnd = random.Random(11)
CORNERS = [(rnd.uniform(-179.0, 170.0), rnd.uniform(-84.0, 79.0)) for _ in range(300)]


def shape(kind, *rings):
    written = ["(" + ", ".join(f"{x!r} {y!r}" for x, y in r) + ")" for r in rings]
    return kind + (written[0] if kind == "LINESTRING" else "(" + ", ".join(written) + ")")


def box(x, y, w=7.3, h=5.1):
    return [(x, y), (x + w, y), (x + w, y + h), (x, y + h), (x, y)]


BOXES = [shape("POLYGON", box(*p)) for p in CORNERS]


def filled(monkeypatch, texts, zoom, cover=False):
    """Cells of texts by the batch function, none of which may be read by itself."""
    want = [geometry.polyfill_list(t, zoom, cover) for t in texts]

    def read(text):
        raise AssertionError(f"read by itself: {text}")

    with monkeypatch.context() as m:
        m.setattr(geometry, "parse", read)
        got = geometry.polyfill_udf(cover).func(pa.array(texts), pa.array([zoom] * len(texts), pa.int64())).to_pylist()
    assert got == want
    return got


def test_batch_for_burn_add(monkeypatch):
    got = filled(monkeypatch, BOXES, 5)
    assert 300 < sum(map(len, got)) > len(set().union(*got))  # boxes overlap, each counts once in a cell
    assert all(len(c) == len(set(c)) for c in got)


def test_batch_for_polyfill_triangle(monkeypatch):
    three = [shape("POLYGON", [(x, y), (x + 7.3, y), (x, y + 5.1), (x, y)]) for x, y in CORNERS]
    whole = filled(monkeypatch, BOXES, 7)
    assert all(set(a) <= set(b) for a, b in zip(filled(monkeypatch, three, 7), whole, strict=True))


def test_batch_for_burn_label(monkeypatch):
    last, want = {}, {}
    for k, (found, text) in enumerate(zip(filled(monkeypatch, BOXES, 5), BOXES, strict=True)):
        last.update(dict.fromkeys(found, k))
        want.update(dict.fromkeys(geometry.polyfill_list(text, 5), k))
    assert last == want


def test_batch_for_polyfill_line(monkeypatch):
    lines = [shape("LINESTRING", [(x, y), (x + 7.3, y + 5.1)]) for x, y in CORNERS] + [shape("LINESTRING", box(*p)) for p in CORNERS]
    assert all(filled(monkeypatch, lines, 9))


def test_batch_for_polyfill_hole(monkeypatch):
    holed = [shape("POLYGON", box(x, y), box(x + 1.1, y + 0.7, 5.3, 3.8)[::-1]) for x, y in CORNERS]
    whole = filled(monkeypatch, BOXES, 8)
    assert any(set(a) < set(b) for a, b in zip(filled(monkeypatch, holed, 8), whole, strict=True))


def test_batch_for_polyfill_rect(monkeypatch):
    edge = [shape("POLYGON", box(x, y, 180 - x, 85.05112877980659 - y)) for x, y in CORNERS[:20]]
    assert all(filled(monkeypatch, BOXES + edge, 7))


def test_batch_for_polyfill_cover(monkeypatch):
    half_open = filled(monkeypatch, BOXES, 7)
    assert all(set(a) < set(b) for a, b in zip(half_open, filled(monkeypatch, BOXES, 7, cover=True), strict=True))


def test_kinds_holes_nulls_and_chunks(monkeypatch):
    square = "((0 0, 20 0, 20 20, 0 20, 0 0))"
    texts = [
        f"POLYGON{square}", f"polygon z ((0 0 1, 9 0 1, 5 9 1))", "POLYGON EMPTY", None, "LINESTRING(0 10, 90 10, 90 -30, 1e1 -3.5E+1)", "LINESTRING(3 3)", "LINESTRING(3 3, 3 3)",
        f"MULTIPOLYGON({square}, ((40 0, 60 0, 60 20, 40 20)))", "MULTIPOINT((0 0), 170 80)", f"GEOMETRYCOLLECTION(POINT(1 1), LINESTRING(-170 80, 170 -80), POLYGON{square})",
        "POLYGON((-180 85.1, 180 85.1, 180 -85.1, -180 -85.1), (-20 20, 20 20, 20 -20, -20 -20, -20 20))", "POLYGON((200 90, 210 90, 210 -90, 200 90))", " LINESTRING ( .5 +1 ,2. 2 ) ",
    ] + BOXES[:20]
    zooms = [(3 * i) % 8 for i in range(len(texts) - 2)] + [None, 27]
    for cells in (1, 100, 1 << 21):
        monkeypatch.setattr(geometry, "CHUNK_CELLS", cells)
        for cover, compat in ((False, False), (True, False), (False, True)):
            got = geometry.polyfill_udf(cover, compat).func(pa.array(texts), pa.array(zooms, pa.int64())).to_pylist()
            assert got == [None if t is None or z is None or z > 26 else geometry.polyfill_list(t, z, cover, compat) for t, z in zip(texts, zooms, strict=True)]
    sizes, found = geometry.polyfill_batch(pa.array([], pa.string()), np.zeros(0, np.int64))
    assert len(sizes) == len(found) == 0


def test_tiles_beside_edges_are_those_of_one_point():
    zooms = [z for z in (1, 6, 13, 26) for _ in range(200)]
    edges = [np.degrees(np.arctan(np.sinh(np.pi * (1 - 2 * rnd.randrange(1 << z) / (1 << z))))) for z in zooms]
    lons = [rnd.choice([-190.0, -180.0, 180.0, rnd.randrange(1 << z) / (1 << z) * 360 - 180]) for z in zooms]
    x, y = geometry.tiles_of(np.array(lons), np.array(edges), np.array(zooms))
    assert list(zip(x.tolist(), y.tolist(), strict=True)) == [geometry.tile_of(p, z) for *p, z in zip(lons, edges, zooms, strict=True)]


@pytest.mark.parametrize("text", ["POLYGON((0 0, 1 1)", "LINESTRING(1)", "LINESTRING(0 0, 1e999 2)", "CIRCLE(1 2)", "LINESTRING(0 0, 1 2) x"])
def test_bad_texts_of_a_batch(text):
    with pytest.raises(GeometryError):
        geometry.polyfill_batch(pa.array([BOXES[0], text]), np.array([3, 3]))
