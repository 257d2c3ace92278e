"""Bytes of a band to numbers: codecs, pixel types, no-data values, statistics. Plain numpy, used inside Arrow functions."""

from __future__ import annotations

import io
import math
import zlib

import numpy as np

from tilewright.errors import CodecError, PixelTypeError, UnsupportedCodecError

#: Pixel types by name: numpy type of the bytes (little-endian) and Spark type of a decoded value.
PIXEL_TYPES = {
    "int8": ("<i1", "tinyint"),
    "uint8": ("<u1", "smallint"),
    "int16": ("<i2", "smallint"),
    "uint16": ("<u2", "int"),
    "int32": ("<i4", "int"),
    "uint32": ("<u4", "bigint"),
    "int64": ("<i8", "bigint"),
    "uint64": ("<u8", "decimal(20,0)"),
    "float32": ("<f4", "float"),
    "float64": ("<f8", "double"),
}


def pixel_type(name: str | None) -> np.dtype:
    """The numpy type of a pixel type's name."""
    try:
        return np.dtype(PIXEL_TYPES[name][0])
    except KeyError:
        raise PixelTypeError(f"unknown pixel type {name!r}") from None


def _picture(data: bytes) -> bytes:
    try:
        from PIL import Image
    except ImportError:
        raise UnsupportedCodecError("jpeg and webp bands need Pillow") from None
    return np.asarray(Image.open(io.BytesIO(data))).tobytes()


def decompress(data: bytes, compression: str | None) -> bytes:
    """A band's raw bytes; empty bands stay empty, unknown compressions count as none."""
    if not data or compression not in ("gzip", "jpeg", "webp"):
        return data
    if compression != "gzip":
        return _picture(data)
    try:
        # the first member only
        return zlib.decompressobj(31).decompress(data)
    except zlib.error as e:
        raise CodecError(f"bad gzip band: {e}") from e


def pixels(data: bytes, data_type: str, tile_size: int, bands: int = 1) -> np.ndarray:
    """All samples of a decompressed band, band after band, row after row."""
    if data_type == "bool":
        bits = np.unpackbits(np.frombuffer(data, np.uint8))
        if len(data) != -(-bands * tile_size * tile_size // 8):
            raise CodecError(f"{len(data)} bytes are no {bands} x {tile_size} x {tile_size} bits")
        return bits[: bands * tile_size * tile_size].astype(bool)
    dtype = pixel_type(data_type)
    if len(data) != bands * tile_size * tile_size * dtype.itemsize:
        raise CodecError(f"{len(data)} bytes are no {bands} x {tile_size} x {tile_size} {data_type}")
    return np.frombuffer(data, dtype)


def cube(data: bytes, data_type: str, tile_size: int, bands: int = 1) -> np.ndarray:
    """The samples as bands x rows x columns."""
    return pixels(data, data_type, tile_size, bands).reshape(bands, tile_size, tile_size)


def no_data_value(text: str | None, data_type: str) -> float | int | None:
    """A no-data text as a pixel of its type; None if it is none."""
    if text is None:
        return None
    dtype = pixel_type(data_type)
    try:
        if dtype.kind == "f":
            return float(dtype.type(text.strip() if text.strip().lower() != "infinity" else "inf"))
        value = int(text)
    except ValueError:
        return None
    info = np.iinfo(dtype)
    return value if info.min <= value <= info.max else None


def valid(values: np.ndarray, no_data: float | int | None, compat: bool = False) -> np.ndarray:
    """Samples that count: neither no-data nor NaN.

    ``compat``: with a no-data value, 32-bit floats drop NaN only and 64-bit floats keep no-data only, as the original
    does; without one nothing is dropped.
    """
    if compat and values.dtype.kind == "f":
        if no_data is None:
            return values
        if values.dtype.itemsize == 4:
            return values[(values.astype(np.float64) == no_data) | ~np.isnan(values)]
        return values[values == no_data]
    keep = ~np.isnan(values) if values.dtype.kind == "f" else np.ones(len(values), bool)
    if no_data is not None and not (isinstance(no_data, float) and math.isnan(no_data)):
        keep &= values != no_data
    return values[keep]


def statistics(values: np.ndarray) -> tuple[float | None, float | None, float | None, float | None, int]:
    """Minimum, maximum, mean, sample standard deviation and number; nulls for none, deviation 0 for one."""
    n = len(values)
    if n == 0:
        return None, None, None, None, 0
    v = values.astype(np.float64)
    return float(v.min()), float(v.max()), float(v.mean()), float(v.std(ddof=1)) if n > 1 else 0.0, n
