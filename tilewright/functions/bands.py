"""Bands as columns: a band is its bytes with a descriptor, carried in a struct or in the field's metadata.

Pixel work runs in Arrow batches in Python; a function that returns numbers of a band (statistics, a pixel) decodes and
reduces in one pass, so whole arrays never travel back. Null bands give null. Bytes that do not fit their descriptor raise.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tilewright.errors import PixelTypeError
from tilewright.functions import cells, codecs
from tilewright.functions.metadata import BandDescriptor, as_column

#: Fields of a band struct.
BAND = "struct<data:binary,tile_size:int,binary_type:string,data_type:string,no_data:string,compression:string,bands:array<string>>"
STATISTICS = "struct<min:double,max:double,mean:double,std_dev:double,valid_count:bigint>"


def _literal(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def band(data: Column | str, tile_size, binary_type="Separated", data_type="uint8", no_data=None, compression="none", bands=None) -> Column:
    """A band struct of bytes and their descriptor; its parts may be numbers, texts or columns."""
    low = F.lower(_literal(compression))
    packed = F.when(low.isin("gzip", "jpeg", "webp"), low).otherwise("none")
    layout = _literal(binary_type)
    known = F.when(layout.isin("Separated", "Interleaved"), layout).otherwise(F.raise_error(F.concat(F.lit("unknown layout "), F.coalesce(layout, F.lit("null")))))
    names = F.array(*map(F.lit, bands)) if bands else F.array(F.lit("band_1"))
    return F.struct(
        as_column(data).alias("data"),
        _literal(tile_size).cast("int").alias("tile_size"),
        known.alias("binary_type"),
        _literal(data_type).cast("string").alias("data_type"),
        _literal(no_data).cast("string").alias("no_data"),
        packed.alias("compression"),
        names.alias("bands"),
    )


def described(df: DataFrame, column: str) -> Column:
    """The band struct of a binary column that carries a descriptor in its field."""
    d = BandDescriptor.from_field(df.schema[column])
    return band(column, d.tile_size, d.binary_type, d.data_type, d.no_data, d.compression, d.bands or None)


def _rows(bands: pa.Array):
    """Each band's bytes and descriptor, None for nulls."""
    cols = [bands.field(i) for i in (0, 1, 3, 4, 5, 6)]  # all but the layout, which changes nothing here
    kinds = [c.to_pylist() for c in cols[1:]]
    for i, there in enumerate(bands.is_valid().to_pylist()):
        data = cols[0][i].as_py() if there else None
        yield None if data is None else (data, *(k[i] for k in kinds))


def _samples(row) -> np.ndarray:
    data, size, kind, _, packed, names = row
    raw = codecs.decompress(data, packed)
    return codecs.pixels(raw, kind, size, max(1, len(names or ()))) if raw else np.zeros(0, codecs.pixel_type(kind))


def _lists(rows, dtype) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Offsets and flat values of lists, without building Python numbers."""
    parts = [None if r is None else _samples(r).astype(dtype, copy=False) for r in rows]
    sizes = [0 if p is None else len(p) for p in parts]
    flat = np.concatenate([p for p in parts if p is not None] or [np.zeros(0, dtype)])
    return np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32), flat, np.array([p is None for p in parts], bool)


def _list_array(offsets, flat: pa.Array, nulls) -> pa.Array:
    at = pa.array(offsets, pa.int32(), mask=np.concatenate([nulls, [False]]))
    return pa.ListArray.from_arrays(at, flat)


@cache
def decompress_udf():
    @F.arrow_udf("binary")
    def decompress_band(bands: pa.Array) -> pa.Array:
        return pa.array([None if r is None else codecs.decompress(r[0], r[4]) for r in _rows(bands)], pa.binary())

    return decompress_band


def decompress(b: Column | str) -> Column:
    """The band with its bytes decompressed."""
    b = as_column(b)
    fields = [b[n].alias(n) for n in ("tile_size", "binary_type", "data_type", "no_data")]
    return F.when(b.isNotNull(), F.struct(decompress_udf()(b).alias("data"), *fields, F.lit("none").alias("compression"), b["bands"].alias("bands")))


@cache
def decode_udf():
    @F.arrow_udf("array<double>")
    def decode_band(bands: pa.Array) -> pa.Array:
        offsets, flat, nulls = _lists(_rows(bands), np.float64)
        return _list_array(offsets, pa.array(flat), nulls)

    return decode_band


def decode(b: Column | str) -> Column:
    """All samples as ARRAY<DOUBLE>; no-data values stay as they are."""
    return decode_udf()(as_column(b))


@cache
def native_udf(data_type: str):
    dtype = codecs.pixel_type(data_type)
    kind = codecs.PIXEL_TYPES[data_type][1]
    to = {"tinyint": pa.int8(), "smallint": pa.int16(), "int": pa.int32(), "bigint": pa.int64(), "float": pa.float32(), "double": pa.float64()}

    @F.arrow_udf(f"array<{kind}>")
    def native_band(bands: pa.Array) -> pa.Array:
        rows = list(_rows(bands))
        for r in rows:
            if r is not None and r[2] != data_type:
                raise PixelTypeError(f"a band of {r[2]} among those of {data_type}")
        offsets, flat, nulls = _lists(rows, dtype)
        values = pa.array(flat).cast(pa.decimal128(20, 0)) if kind.startswith("decimal") else pa.array(flat).cast(to[kind])
        return _list_array(offsets, values, nulls)

    return native_band


def native(b: Column | str, data_type: str) -> Column:
    """All samples as an array of the pixel type, which must be known when the query is planned."""
    return native_udf(data_type)(as_column(b))


@cache
def statistics_udf(compat: bool = False):
    @F.arrow_udf(STATISTICS)
    def band_statistics(bands: pa.Array) -> pa.Array:
        rows = []
        for r in _rows(bands):
            if r is None:
                rows.append(None)
                continue
            counted = codecs.valid(_samples(r), codecs.no_data_value(r[3], r[2]), compat)
            rows.append(dict(zip(("min", "max", "mean", "std_dev", "valid_count"), codecs.statistics(counted), strict=True)))
        numbers = [(n, pa.float64()) for n in ("min", "max", "mean", "std_dev")]
        return pa.array(rows, pa.struct([*numbers, ("valid_count", pa.int64())]))

    return band_statistics


def statistics(b: Column | str, compat: bool = False) -> Column:
    """STRUCT(min, max, mean, std_dev, valid_count) over samples that are neither no-data nor NaN."""
    return statistics_udf(compat)(as_column(b))


#: Bytes of decoded tiles that a batch of pixels keeps at hand.
HELD = 64 << 20


def _decoded():
    """A function from a row to its samples that decodes a tile once for rows that follow one another closely."""
    held: dict = {}
    size = 0

    def samples(row) -> np.ndarray:
        nonlocal size
        data, side, kind, _, packed, names = row
        key = (data, side, kind, packed, len(names or ()))
        found = held.get(key)
        if found is None:
            found = _samples(row)
            size += found.nbytes + len(data)
            if size > HELD:
                held.clear()
                size = found.nbytes + len(data)
            held[key] = found
        return found

    return samples


@cache
def pixel_udf():
    @F.arrow_udf("double")
    def band_pixel(bands: pa.Array, xs: pa.Array, ys: pa.Array, numbers: pa.Array) -> pa.Array:
        out, samples = [], _decoded()
        for r, x, y, k in zip(_rows(bands), xs.to_pylist(), ys.to_pylist(), numbers.to_pylist(), strict=True):
            if r is None or x is None or y is None or k is None:
                out.append(None)
                continue
            size = r[1]
            inside = 0 <= x < size and 0 <= y < size and 0 <= k < max(1, len(r[5] or ()))
            values = samples(r) if inside else ()
            at = (k * size + y) * size + x
            out.append(float(values[at]) if inside and at < len(values) else None)
        return pa.array(out, pa.float64())

    return band_pixel


def pixel(b: Column | str, x, y, number=0) -> Column:
    """The sample at a pixel of a band (of the first, if it has several); null beyond the tile."""
    return pixel_udf()(as_column(b), cells.long(x), cells.long(y), cells.long(number))


def sampler(out: T.StructType):
    """Of rows (block, copy, kind, band, at, tile, point), each tile (kind 0) before its points: (block, tile, point, value).

    ``at`` is a place in the tile, in 32,768ths of its side. Rows of a tile without points and of points without one go.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = to_arrow_schema(out)

    def run(batches):
        block, copy, held, side, tile = None, None, (), 0, None
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            blocks, copies, kinds = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            at = batch.column(4)
            xs, ys = (pc.fill_null(at.field(i), 0).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(2))
            edges = np.flatnonzero(np.concatenate([[True], (blocks[1:] != blocks[:-1]) | (copies[1:] != copies[:-1]) | (kinds[1:] != kinds[:-1]) | (kinds[1:] == 0), [True]]))
            # the tile at hand comes before those of the batch
            carried = batch.column(5).slice(0, 1) if tile is None else tile
            values, there, met, own, last = np.zeros(n), np.zeros(n, bool), np.zeros(n, bool), np.zeros(n, np.int64), 0
            for a, b in zip(edges.tolist(), edges[1:].tolist(), strict=False):
                if kinds[a] == 0:
                    row = next(_rows(batch.column(3).slice(a, 1)))
                    block, copy, last = blocks[a], copies[a], a + 1
                    held, side = (_samples(row), row[1]) if row is not None else ((), 0)
                elif (blocks[a], copies[a]) == (block, copy):
                    met[a:b], own[a:b] = True, last
                    if side:
                        place = (ys[a:b] * side >> 15) * side + (xs[a:b] * side >> 15)
                        inside = place < len(held)
                        there[a:b] = inside
                        values[a:b][inside] = held[place[inside]]
            tiles = pa.concat_arrays([carried, batch.column(5)])
            tile = tiles.slice(last, 1)
            chosen = np.flatnonzero(met)
            if len(chosen):
                at = pa.array(chosen)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(at), tiles.take(pa.array(own[chosen])).cast(schema.field(1).type), batch.column(6).take(at).cast(schema.field(2).type), pa.array(values[chosen], mask=~there[chosen])], schema=schema)

    return run


POINT = r"^\s*(?i:POINT)\s*(?i:ZM|Z|M)?\s*\(\s*([-+0-9.eE]+)\s+([-+0-9.eE]+)(?:\s+[-+0-9.eE]+)*\s*\)\s*$"


def point(wkt: Column | str) -> tuple[Column, Column]:
    """Longitude and latitude of a POINT; null for other texts."""
    text = as_column(wkt)
    return tuple(F.regexp_extract(text, POINT, i).try_cast("double") for i in (1, 2))


def value(b: Column | str, wkt: Column | str, resolution) -> Column:
    """The sample under a POINT at a zoom. The band is not tested to be that of the point's tile."""
    b = as_column(b)
    lon, lat = point(wkt)
    at = cells.pixel_xy(lon, lat, resolution, b["tile_size"])
    return pixel(b, at["pixel_x"], at["pixel_y"])
