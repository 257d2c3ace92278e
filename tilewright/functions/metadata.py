"""The metadata document of a tile table, and the descriptor of a band."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tilewright.errors import MetadataError

#: Fixed value: the fields of the document, all optional.
DOCUMENT = """
file_format STRING, version STRING, width INT, height INT, crs STRING, bounds ARRAY<DOUBLE>, bounds_crs STRING,
compression STRING, compression_quality INT, band_layout STRING,
tiling STRUCT<scheme: STRING, block_width: INT, block_height: INT, min_zoom: INT, max_zoom: INT, pixel_zoom: INT, num_blocks: INT>,
tile_statistics BOOLEAN, tile_statistics_columns ARRAY<STRING>,
bands ARRAY<STRUCT<name: STRING, description: STRING, type: STRING, nodata: STRING, unit: STRING, scale: DOUBLE, offset: DOUBLE,
    colortable: STRING, has_scale: DOUBLE, has_offset: DOUBLE>>,
time STRUCT<`cf:units`: STRING, `cf:calendar`: STRING, resolution: STRING, interpretation: STRING, count: INT, range: ARRAY<INT>>
"""
DOCUMENT_TYPE = " ".join(DOCUMENT.split())

#: Key of a field's metadata that holds a descriptor.
BAND_KEY, CELL_KEY = "raster", "quadbin"
COMPRESSIONS = ("none", "gzip", "jpeg", "webp")
LAYOUTS = ("Separated", "Interleaved")


@dataclass(frozen=True)
class BandDescriptor:
    """What is needed to read a band's bytes."""

    tile_size: int
    binary_type: str = "Separated"
    data_type: str = "uint8"
    no_data: str | None = None
    compression: str = "none"
    bands: tuple[str, ...] = ()

    def to_metadata(self) -> dict:
        return {BAND_KEY: json.dumps(asdict(self))}

    @classmethod
    def from_field(cls, field: T.StructField) -> BandDescriptor:
        """The descriptor of a column, or MetadataError."""
        try:
            d = json.loads((field.metadata or {})[BAND_KEY])
            return cls(**{**d, "bands": tuple(d["bands"])})
        except (KeyError, TypeError, ValueError) as e:
            raise MetadataError(f"column {field.name} carries no band descriptor") from e


@dataclass(frozen=True)
class CellDescriptor:
    """The zooms of a cell column."""

    min_zoom: int
    max_zoom: int

    def to_metadata(self) -> dict:
        return {CELL_KEY: json.dumps(asdict(self))}

    @classmethod
    def from_field(cls, field: T.StructField) -> CellDescriptor:
        try:
            return cls(**json.loads((field.metadata or {})[CELL_KEY]))
        except (KeyError, TypeError, ValueError) as e:
            raise MetadataError(f"column {field.name} carries no zooms") from e


def as_column(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def document(metadata: Column | str) -> Column:
    """The document of a JSON text; null if it is none."""
    return F.from_json(as_column(metadata), DOCUMENT_TYPE)


def compression_of(text: Column) -> Column:
    """A known compression's name, else none."""
    low = F.lower(text)
    return F.when(low.isin(*COMPRESSIONS), low).otherwise("none")


def band_metadata(band_name: Column | str, metadata: Column | str) -> Column:
    """STRUCT(tile_size, binary_type, data_type, no_data, compression) of a named band; null for an unknown one.

    The no-data value is that of the first band, for all bands.
    """
    doc, name = document(metadata), as_column(band_name)
    band = F.get(F.filter(doc["bands"], lambda b: b["name"] == name), F.lit(0))
    found = F.struct(
        doc["tiling"]["block_height"].alias("tile_size"),
        F.lit("Separated").alias("binary_type"),
        band["type"].alias("data_type"),
        F.get(doc["bands"], F.lit(0))["nodata"].alias("no_data"),
        compression_of(doc["compression"]).alias("compression"),
    )
    return F.when(band.isNotNull() & doc["tiling"].isNotNull(), found)


def quadbin_metadata(metadata: Column | str) -> Column:
    """STRUCT(min_zoom, max_zoom)."""
    tiling = document(metadata)["tiling"]
    return F.when(tiling.isNotNull(), F.struct(tiling["min_zoom"].alias("min_zoom"), tiling["max_zoom"].alias("max_zoom")))


def read_document(tiles: DataFrame) -> dict | None:
    """The document of a tile table, from its row of block 0: one small read on the driver."""
    row = tiles.where(F.col("block") == 0).select("metadata").first()
    if row is None or row.metadata is None:
        return None
    try:
        return json.loads(row.metadata)
    except ValueError as e:
        raise MetadataError("the metadata row holds no JSON") from e


def describe(doc: dict, binary_columns: list[str]) -> dict[str, BandDescriptor]:
    """Descriptors by column: one band a column by name if numbers agree, else all bands in the first column."""
    try:
        size, bands = doc["tiling"]["block_height"], doc["bands"]
        names = [b["name"] for b in bands]
    except (KeyError, TypeError) as e:
        raise MetadataError("the document lacks tiling or bands") from e
    nodata = bands[0].get("nodata") if bands else None
    nodata = None if nodata is None else str(nodata)
    packed = str(doc.get("compression") or "none").lower()
    packed = packed if packed in COMPRESSIONS else "none"
    if len(bands) == len(binary_columns):
        return {b["name"]: BandDescriptor(size, "Separated", b.get("type") or "uint8", nodata, packed, (b["name"],)) for b in bands if b["name"] in binary_columns}
    if not binary_columns or not bands:
        return {}
    return {binary_columns[0]: BandDescriptor(size, "Interleaved", bands[0].get("type") or "uint8", nodata, packed, tuple(names))}
