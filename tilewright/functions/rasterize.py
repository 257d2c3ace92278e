"""Shapes burnt into arrays: values replace or add up, labels tell shapes apart, and an affine transform places the grid.

A shape is a well-known text or a part as ``geometry.parse`` gives it, its coordinates those of the grid, or of the world
where a transform ``(a, b, c, d, e, f)`` is given: a grid's column and row lie at ``x = a * column + b * row + c``,
``y = d * column + e * row + f``.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np

from tilewright.errors import GeometryError
from tilewright.functions import geometry

Part = tuple[str, object]


def rectangle(x0: float, y0: float, x1: float, y1: float) -> Part:
    """A polygon of two corners."""
    return "POLYGON", [[(x0, y0), (x1, y0), (x1, y1), (x0, y1), (x0, y0)]]


def triangle(a: geometry.Point, b: geometry.Point, c: geometry.Point) -> Part:
    """A polygon of three corners."""
    return "POLYGON", [[a, b, c, a]]


def to_grid(transform: tuple[float, ...] | None):
    """The function from a place in the world to one in the grid."""
    if transform is None:
        return lambda p: p
    a, b, c, d, e, f = transform
    area = a * e - b * d
    if not area:
        raise GeometryError("the transform has no inverse")
    return lambda p: ((e * (p[0] - c) - b * (p[1] - f)) / area, (a * (p[1] - f) - d * (p[0] - c)) / area)


def shape_cells(part: Part, width: int, height: int, transform: tuple[float, ...] | None = None) -> geometry.Cells:
    """Cells (x, y) of a part on a grid, each once, row by row."""
    kind, body = part
    place = to_grid(transform)
    if kind == "POINT":
        x, y = (np.array([np.floor(v)]).astype(np.int64) for v in place(body))
        inside = (x >= 0) & (x < width) & (y >= 0) & (y < height)
        return x[inside], y[inside]
    if kind == "LINESTRING":
        ring = [place(p) for p in body]
        found = geometry.line_cells(np.array([(*p, *q) for p, q in zip(ring, ring[1:], strict=False)], np.float64).reshape(-1, 4), width, height)
    elif kind == "POLYGON":
        found = geometry.polygon_cells([[place(p) for p in r] for r in body], width, height)
    else:
        raise GeometryError(f"cannot draw {kind}")
    return geometry.distinct(*found, width)


def parts_of(shape: str | Part | list[Part]) -> list[Part]:
    return geometry.parse(shape) if isinstance(shape, str) else shape if isinstance(shape, list) else [shape]


def rasterize(shapes: Iterable[tuple[object, float]], width: int, height: int, transform: tuple[float, ...] | None = None, merge: str = "replace", background: float = 0, dtype="float64") -> np.ndarray:
    """An array (rows, columns) of the values of shapes (shape, value), in their order.

    ``merge``: a later value takes the place of an earlier one (``replace``), or is added to it and the background (``add``).
    A shape counts once in a cell, however many of its parts touch it.
    """
    if merge not in ("replace", "add"):
        raise GeometryError(f"unknown merge {merge!r}")
    out = np.full((height, width), background, dtype)
    for shape, value in shapes:
        found = [shape_cells(p, width, height, transform) for p in parts_of(shape)]
        if not found:
            continue
        x, y = geometry.distinct(*(np.concatenate(v) for v in zip(*found, strict=True)), width)
        if merge == "add":
            out[y, x] += np.dtype(dtype).type(value)
        else:
            out[y, x] = value
    return out


def labelled(shapes: Iterable[object], width: int, height: int, transform: tuple[float, ...] | None = None, dtype="uint32") -> np.ndarray:
    """An array of labels: the place, from 1, of the last shape that touches a cell, 0 for none."""
    return rasterize(((s, i) for i, s in enumerate(shapes, 1)), width, height, transform, dtype=dtype)


def touched(shapes: Iterable[object], width: int, height: int, transform: tuple[float, ...] | None = None) -> np.ndarray:
    """An array of whether any shape touches a cell."""
    return rasterize(((s, 1) for s in shapes), width, height, transform, dtype="uint8").astype(bool)
