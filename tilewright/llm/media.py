"""Media columns: Netpbm and BMP to arrays, area-resized tiles in NPY form, difference hashes.

``media_tiles`` reads a binary column of images (P1 to P6, or uncompressed BMP of 1, 4, 8, 24 or 32 bits), resizes each to
a small grey tile by an integral image and returns the tile as the bytes of an NPY file beside its difference hash.
Images of any height are read in bands of rows: the integral image is kept only on the lines that a tile cell starts or
ends at, so memory follows the width and the band, not the picture.

Defined cases: null or undecodable media give null in every result column; extra columns pass through, but those that have
the name of a result column are replaced; repeated rows give repeated results; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import io
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tilewright.llm.common import extend, materialise

TILE_HEIGHT, TILE_WIDTH = 8, 9
BAND_ROWS = 4096
SAMPLES_PER_ROW = 64

TILE_COLUMNS = T.StructType(
    [
        T.StructField("media_width", T.IntegerType()),
        T.StructField("media_height", T.LongType()),
        T.StructField("media_channels", T.IntegerType()),
        T.StructField("tile_npy", T.BinaryType()),
        T.StructField("dhash", T.StringType()),
    ]
)


class MediaError(ValueError):
    """The bytes are no Netpbm or BMP picture that this module reads."""


def _netpbm_header(data: memoryview, fields: int) -> tuple[list[int], int]:
    """The numbers after the magic, comments skipped, and where the samples start."""
    found, at = [], 2
    while len(found) < fields:
        while at < len(data) and data[at] in b" \t\r\n\x0b\x0c":
            at += 1
        if at < len(data) and data[at] == 0x23:
            while at < len(data) and data[at] not in b"\r\n":
                at += 1
            continue
        start = at
        while at < len(data) and 0x30 <= data[at] <= 0x39:
            at += 1
        if start == at or at - start > 10:
            raise MediaError("bad Netpbm header")
        found.append(int(bytes(data[start:at])))
    return found, at + 1


def decode_netpbm(data: memoryview) -> np.ndarray:
    """Height x width x channels; 16-bit samples stay 16 bits."""
    kind = data[1] - 0x30
    fields, at = _netpbm_header(data, 2 if kind in (1, 4) else 3)
    width, height, top = fields[0], fields[1], fields[2] if len(fields) == 3 else 1
    if not width or not height or not 0 < top < 65536:
        raise MediaError("bad Netpbm size")
    channels = 3 if kind in (3, 6) else 1
    n = width * height * channels
    if kind == 4:
        row = -(-width // 8)
        if len(data) - at < row * height:
            raise MediaError("truncated")
        bits = np.unpackbits(np.frombuffer(data, np.uint8, row * height, at).reshape(height, row), axis=1)[:, :width]
        return (1 - bits)[..., None] * np.uint8(255)
    if kind in (5, 6):
        dtype = np.dtype("u1" if top < 256 else ">u2")
        if len(data) - at < n * dtype.itemsize:
            raise MediaError("truncated")
        return np.frombuffer(data, dtype, n, at).reshape(height, width, channels)
    plain = bytes(data[at - 1 :])
    if kind == 1:
        marks = np.frombuffer(plain, np.uint8)
        marks = marks[(marks == 0x30) | (marks == 0x31)][:n]
        if len(marks) < n:
            raise MediaError("truncated")
        return ((0x31 - marks) * np.uint8(255)).reshape(height, width, 1)
    if kind not in (2, 3):
        raise MediaError("unknown Netpbm kind")
    try:
        values = np.array(plain.split()[:n], dtype=np.int64)
    except ValueError as e:
        raise MediaError("bad plain sample") from e
    if len(values) < n or (n and (values.min() < 0 or values.max() > top)):
        raise MediaError("truncated or out of range")
    return values.astype(np.uint8 if top < 256 else np.uint16).reshape(height, width, channels)


def decode_bmp(data: memoryview) -> np.ndarray:
    """Height x width x channels, top row first; palettes are resolved."""
    if len(data) < 54:
        raise MediaError("truncated")
    offset, header = struct.unpack_from("<I", data, 10)[0], struct.unpack_from("<I", data, 14)[0]
    if header < 40:
        raise MediaError("old BMP header")
    width, height, _, bits, packed = struct.unpack_from("<iiHHI", data, 18)
    colours = struct.unpack_from("<I", data, 46)[0]
    flip, height = height > 0, abs(height)
    if packed not in (0, 3) or width <= 0 or not height or bits not in (1, 4, 8, 24, 32):
        raise MediaError("unsupported BMP")
    row = (width * bits + 31) // 32 * 4
    if len(data) - offset < row * height:
        raise MediaError("truncated")
    rows = np.frombuffer(data, np.uint8, row * height, offset).reshape(height, row)
    if bits <= 8:
        n = colours or 1 << bits
        palette = np.frombuffer(data, np.uint8, 4 * n, 14 + header).reshape(n, 4)[:, 2::-1]
        if bits == 8:
            index = rows[:, :width]
        elif bits == 4:
            index = np.stack([rows >> 4, rows & 15], axis=2).reshape(height, -1)[:, :width]
        else:
            index = np.unpackbits(rows, axis=1)[:, :width]
        if index.size and index.max() >= n:
            raise MediaError("palette index out of range")
        img = palette[index]
    else:
        img = rows[:, : width * bits // 8].reshape(height, width, bits // 8)[:, :, 2::-1]
    return img[::-1] if flip else img


def decode(data: bytes | memoryview) -> np.ndarray:
    """A picture's samples, or MediaError."""
    data = memoryview(data)
    if len(data) >= 3 and data[0] == 0x50 and 0x31 <= data[1] <= 0x36:
        return decode_netpbm(data)
    if len(data) >= 2 and bytes(data[:2]) == b"BM":
        try:
            return decode_bmp(data)
        except (struct.error, ValueError) as e:
            raise MediaError(str(e)) from e
    raise MediaError("unknown format")


def _cuts(size: int, parts: int) -> np.ndarray:
    return np.arange(parts + 1) * (size / parts)


def _grey(band: np.ndarray) -> np.ndarray:
    """Mean of the colour channels, as sums of whole numbers; alpha is left out."""
    if band.shape[2] == 1:
        return band[:, :, 0]
    return band[:, :, :3].sum(axis=2, dtype=np.int64) / 3


def area_resize(img: np.ndarray, height: int = TILE_HEIGHT, width: int = TILE_WIDTH) -> np.ndarray:
    """Mean over each cell of a height x width grid, cells of fractional edges weighted by area.

    The integral image S(y, x) is the sum of all samples above y and left of x. It is linear between whole coordinates, so
    its values at the grid's corners give each cell by three subtractions.
    """
    h, w = img.shape[:2]
    ys, xs = _cuts(h, height), _cuts(w, width)
    whole = np.minimum(ys.astype(np.int64), h)
    above = np.zeros(w, np.float64)
    lines = np.zeros((height + 1, w), np.float64)
    k = 0
    for y0 in range(0, h, BAND_ROWS):
        band = _grey(img[y0 : y0 + BAND_ROWS])
        y1 = y0 + len(band)
        start = y0
        while k <= height and whole[k] < y1:
            above = above + band[start - y0 : whole[k] - y0].sum(axis=0, dtype=np.float64)
            start = whole[k]
            lines[k] = above + (ys[k] - whole[k]) * band[start - y0]
            k += 1
        above = above + band[start - y0 :].sum(axis=0, dtype=np.float64)
    lines[k:] = above
    across = np.concatenate([np.zeros((height + 1, 1)), np.cumsum(lines, axis=1)], axis=1)
    left = np.minimum(xs.astype(np.int64), w)
    right = np.minimum(left + 1, w)
    corners = across[:, left] + (xs - left) * (across[:, right] - across[:, left])
    cells = corners[1:, 1:] - corners[:-1, 1:] - corners[1:, :-1] + corners[:-1, :-1]
    return cells / ((h / height) * (w / width))


def difference_hash(tile: np.ndarray) -> str:
    """A bit for each neighbour to the right that is brighter, row by row, as hexadecimal digits."""
    bits = (tile[:, 1:] > tile[:, :-1]).ravel()
    return np.packbits(bits).tobytes().hex()


def npy_bytes(array: np.ndarray) -> bytes:
    """The bytes of an NPY file that holds ``array``."""
    out = io.BytesIO()
    np.lib.format.write_array(out, np.ascontiguousarray(array), allow_pickle=False)
    return out.getvalue()


def encode_pgm(payload: bytes, width: int = SAMPLES_PER_ROW) -> bytes:
    """Raw bytes as 8-bit grey samples, ``width`` to a row; the length must be a multiple of it."""
    return b"P5\n%d %d\n255\n" % (width, len(payload) // width) + payload


def _tile_columns(col: pa.Array) -> list:
    rows = []
    for s in col:
        try:
            img = decode(s.as_buffer()) if s.is_valid else None
        except MediaError:
            img = None
        if img is None:
            rows.append((None,) * 5)
            continue
        tile = np.rint(area_resize(img) * 256).astype("<i4")  # fixed point: equal pictures, equal bytes on any machine
        rows.append((img.shape[1], img.shape[0], img.shape[2], npy_bytes(tile), difference_hash(tile)))
    return [list(x) for x in zip(*rows, strict=True)] if rows else [[]] * 5


def media_tiles(df: DataFrame, media_col: str = "media") -> DataFrame:
    """``df`` without the pictures, with size, NPY tile (int32, sample value x 256) and difference hash."""
    return extend(df, media_col, TILE_COLUMNS, lambda: _tile_columns, keep_text=False)


def text_media(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Texts as PGM pictures instead of the texts: UTF-8, zero bytes up to a positive multiple of 64, 64 samples to a row. Null counts as empty."""

    def compute():
        def run(col: pa.Array) -> list:
            media, sizes = [], []
            for s in col.cast(pa.large_binary()):
                b = s.as_py() or b""
                sizes.append(len(b))
                media.append(encode_pgm(b + bytes(-len(b) % SAMPLES_PER_ROW if b else SAMPLES_PER_ROW)))
            return [sizes, media]

        return run

    added = T.StructType([T.StructField("n_bytes", T.LongType()), T.StructField("media", T.BinaryType())])
    return extend(docs, text_col, added, compute, keep_text=False)


DIGESTS = T.StructType(
    [
        T.StructField("payload_bytes", T.LongType()),
        T.StructField("payload_sha256", T.StringType()),
        T.StructField("tail_crc32", T.LongType()),
        T.StructField("media_bytes", T.LongType()),
        T.StructField("media_sha256", T.StringType()),
        *TILE_COLUMNS.fields,
    ]
)


def _digests(col: pa.Array) -> list:
    """Of stored pictures: digests of the samples as decoded and of the stored bytes, and the tile columns."""
    rows = []
    for s in col:
        stored = s.as_buffer()
        payload = np.ascontiguousarray(decode(stored)).reshape(-1)
        rows.append((payload.nbytes, hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-SAMPLES_PER_ROW:]), len(stored), hashlib.sha256(stored).hexdigest()))
    own = [list(x) for x in zip(*rows, strict=True)] if rows else [[]] * 5
    return [*own, *_tile_columns(col)]


def op10_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts stored as pictures in the shared folder, read back and described."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    stored = materialise(text_media(docs), "media")
    read = extend(stored, "media", DIGESTS, lambda: _digests, keep_text=False)
    return read.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", F.col("dhash").alias("feature"), F.sha2("tile_npy", 256).alias("tile_sha256"))
