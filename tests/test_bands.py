"""Bands, metadata, tile tables, statistics over tiles, streams."""

import gzip
import json
import math

import numpy as np
import pytest
from pyspark.errors import PythonException
from pyspark.sql import functions as F

from tilewright.errors import CodecError, MetadataError, PixelTypeError, UnsupportedCodecError
from tilewright.functions import bands, cells, codecs, geometry, metadata
from tilewright.functions.register import register
from tilewright.operators import zonal
from tilewright.plans import fixtures
from tilewright.sources import tiles as source
from tilewright.streaming import points


def tile(values, kind, packed="gzip"):
    raw = np.array(values).astype(codecs.pixel_type(kind)).tobytes()
    return bytearray(gzip.compress(raw) if packed == "gzip" else raw)


RANGES = {"int8": (-128, 127), "uint8": (0, 255), "int16": (-32768, 32767), "uint16": (0, 65535), "int32": (-(1 << 31), (1 << 31) - 1), "uint32": (0, (1 << 32) - 1), "int64": (-(1 << 62), 1 << 62), "uint64": (0, (1 << 64) - 1)}


@pytest.mark.parametrize("kind", codecs.PIXEL_TYPES)
def test_every_pixel_type(spark, kind):
    low, high = RANGES.get(kind, (-1.5, 2.5))
    values = np.array([low, high, 0, 1], codecs.pixel_type(kind))
    df = spark.createDataFrame([(tile(values, kind),), (None,)], "d binary").select(F.when(F.col("d").isNotNull(), bands.band("d", 2, data_type=kind, compression="gzip")).alias("b"))
    got = df.select(bands.native("b", kind).alias("n"), bands.decode("b").alias("d"), bands.statistics("b").alias("s")).collect()
    assert [float(x) for x in got[0].n] == [float(v) for v in values] == got[0].d
    assert got[0].s.min == float(values.min()) and got[0].s.valid_count == 4
    assert tuple(got[1]) == (None, None, None)


def test_interleaved_bands_and_pixels(spark):
    data = tile(range(32), "int16", "none")
    b = bands.band(F.lit(data), 4, "Interleaved", "int16", bands=("r", "g"))
    one = spark.range(1).select(bands.pixel(b, 1, 2).alias("first"), bands.pixel(b, 1, 2, 1).alias("second"), bands.pixel(b, 4, 0).alias("beyond"), bands.pixel(b, -1, 0).alias("before"), bands.pixel(b, 0, 0, 2).alias("no_band")).first()
    assert tuple(one) == (9.0, 25.0, None, None, None)


def test_bits_and_codecs():
    assert codecs.pixels(bytes([0b10100000, 0]), "bool", 3).tolist() == [True, False, True] + [False] * 6
    assert codecs.cube(bytes(range(8)), "uint8", 2, 2).tolist() == [[[0, 1], [2, 3]], [[4, 5], [6, 7]]]
    with pytest.raises(CodecError):
        codecs.pixels(b"abc", "int16", 1)
    with pytest.raises(PixelTypeError):
        codecs.pixel_type("int128")
    with pytest.raises(CodecError):
        codecs.decompress(b"no gzip", "gzip")
    with pytest.raises((UnsupportedCodecError, Exception)):
        codecs.decompress(b"no picture", "jpeg")
    assert codecs.decompress(b"", "gzip") == b"" and codecs.decompress(b"x", "none") == b"x"
    two = gzip.compress(b"ab") + gzip.compress(b"cd")
    assert codecs.decompress(two, "gzip") == b"ab"


def test_no_data():
    assert codecs.no_data_value("NaN", "float32") != codecs.no_data_value("NaN", "float32")
    assert codecs.no_data_value("-9999", "int16") == -9999 and codecs.no_data_value("-1", "uint8") is None
    assert codecs.no_data_value("0.5", "int8") is None and codecs.no_data_value(None, "int8") is None and codecs.no_data_value("x", "float64") is None
    f = np.array([1.0, math.nan, -9999.0, 3.0])
    assert codecs.valid(f.astype("<f4"), -9999.0).tolist() == [1.0, 3.0] and codecs.valid(f, math.nan).tolist() == [1.0, -9999.0, 3.0]
    # as the original counts
    assert codecs.valid(f, -9999.0, compat=True).tolist() == [-9999.0]
    assert codecs.valid(f.astype("<f4"), -9999.0, compat=True).tolist() == [1.0, -9999.0, 3.0]
    assert len(codecs.valid(f, None, compat=True)) == 4
    assert codecs.statistics(np.zeros(0)) == (None, None, None, None, 0)
    assert codecs.statistics(np.array([4])) == (4.0, 4.0, 4.0, 0.0, 1)


def test_wrong_length_raises(spark):
    df = spark.createDataFrame([(bytearray(b"abc"),)], "d binary")
    with pytest.raises(PythonException, match="no 1 x 2 x 2 float32"):
        df.select(bands.decode(bands.band("d", 2, data_type="float32"))).collect()
    empty = spark.createDataFrame([(bytearray(b""),)], "d binary").select(bands.statistics(bands.band("d", 2, data_type="float32")).alias("s")).first()
    assert empty.s.valid_count == 0 and empty.s.mean is None


def test_native_from_sql(spark):
    register(spark)
    data = tile([100, 200, -100, -200], "int16", "none").hex()
    row = spark.sql(f"SELECT p.pixels FROM (SELECT binary_to_raquet(X'{data}', '2', 'Separated', 'int16', '1', 'none') AS b) t, LATERAL raquet_band_native(b, 'int16') p")
    assert row.first().pixels == [100, 200, -100, -200] and row.schema["pixels"].dataType.elementType.simpleString() == "smallint"
    value = spark.sql(f"SELECT raquet_value(binary_to_raquet(X'{data}', '2', 'Separated', 'int16', '1', 'none'), 'POINT(-3.7038 40.4168)', 9) AS v, raquet_value(NULL, 'POINT(0 0)', 9) AS n").first()
    assert value.v == 200.0 and value.n is None


def test_band_metadata(spark):
    good = json.dumps(fixtures.DOCUMENT)
    df = spark.createDataFrame([(good, "band_1"), (good, "nothing"), ("{bad", "band_1"), (None, "band_1"), ("{}", "band_1")], "m string, n string")
    got = [r.b for r in df.select(metadata.band_metadata("n", "m").alias("b")).collect()]
    assert tuple(got[0]) == (8, "Separated", "float32", "NaN", "gzip") and got[1:] == [None] * 4
    zooms = [r.z for r in df.select(metadata.quadbin_metadata("m").alias("z")).collect()]
    assert tuple(zooms[0]) == (2, 6) and zooms[2:] == [None] * 3


def test_layouts_by_number_of_columns():
    doc = {"tiling": {"block_height": 4}, "compression": "odd", "bands": [{"name": "a", "type": "int8", "nodata": 0}, {"name": "b", "type": "int8"}]}
    assert metadata.describe(doc, ["a", "b"])["b"] == metadata.BandDescriptor(4, "Separated", "int8", "0", "none", ("b",))
    assert metadata.describe(doc, ["pixels"])["pixels"].bands == ("a", "b")
    with pytest.raises(MetadataError):
        metadata.describe({}, [])


def test_tile_table_round_trip(spark, sf, tmp_path):
    path = str(tmp_path / "tiles")
    source.write_tiles(source.read_tiles(fixtures.raster(spark, sf)), path, fixtures.DOCUMENT)
    df = source.read_raster_parquet(spark, path)
    assert metadata.BandDescriptor.from_field(df.schema["band_1"]).data_type == "float32"
    assert metadata.CellDescriptor.from_field(df.schema["block"]) == metadata.CellDescriptor(2, 6)
    assert source.read_metadata(df).count() == 1 and source.read_tiles(df).count() == spark.read.parquet(f"{sf}/embeddings.parquet").count()
    with pytest.raises(MetadataError):
        metadata.BandDescriptor.from_field(df.schema["metadata"])
    source.register_raster_table(spark, "solar", path)
    assert spark.sql("SELECT count(*) AS n FROM solar_tiles").first().n == source.read_tiles(source.read_table(spark, "solar")).count()
    point = "POINT(-179 85)"
    near = source.read_at(df, point)
    assert [r.block for r in near.select("block").collect()] == geometry.polyfill_list(point, 6)
    assert "PushedFilters: [In(block" in near._jdf.queryExecution().executedPlan().toString() or "EqualTo(block" in near._jdf.queryExecution().executedPlan().toString()
    wide = source.read_at(df, "POLYGON((-180 85, 180 85, 180 -85, -180 -85, -180 85))")
    assert wide.count() >= 400 and "LeftSemi" in wide._jdf.queryExecution().optimizedPlan().toString()


def test_unsigned_cells_are_read_signed(spark, tmp_path):
    import pyarrow as pa
    import pyarrow.parquet as pq

    block = [0, geometry.encode_tile(1, 1, 3)]
    doc = json.dumps({**fixtures.DOCUMENT, "bands": [{"name": "band_1", "type": "uint8"}], "tiling": {"block_height": 2, "min_zoom": 3, "max_zoom": 3}})
    pq.write_table(pa.table({"block": pa.array(block, pa.uint64()), "metadata": [doc, None], "band_1": pa.array([None, gzip.compress(b"abcd")], pa.binary())}), tmp_path / "t.parquet")
    df = source.read_raster_parquet(spark, str(tmp_path / "t.parquet"))
    assert dict(df.dtypes)["block"] == "bigint"
    got = source.read_tiles(df).select(bands.decode(bands.described(df, "band_1")).alias("d")).first().d
    assert got == [97.0, 98.0, 99.0, 100.0]
    with pytest.raises(MetadataError):
        pq.write_table(pa.table({"block": pa.array([5], pa.int64()), "metadata": pa.array([None], pa.string())}), tmp_path / "none.parquet")
        source.read_raster_parquet(spark, str(tmp_path / "none.parquet"))


def test_zonal_statistics_merge(spark):
    rng = np.random.default_rng(0)
    parts = [rng.normal(i, 1 + i, 4 * (i + 1)) for i in range(4)]
    rows = [(i, dict(zip(("min", "max", "mean", "std_dev", "valid_count"), codecs.statistics(p), strict=True))) for i, p in enumerate(parts)] + [(9, dict(min=None, max=None, mean=None, std_dev=None, valid_count=0))]
    df = spark.createDataFrame(rows, f"block long, stats {bands.STATISTICS}")
    zones = spark.createDataFrame([("a", i) for i in range(4)] + [("b", 2), ("c", 9)], "zone string, block long")
    got = {r.zone: r for r in zonal.zonal_statistics(df, zones).collect()}
    assert (got["a"].mean, got["a"].std_dev, got["a"].valid_count) == pytest.approx(codecs.statistics(np.concatenate(parts))[2:])
    assert got["b"].std_dev == pytest.approx(codecs.statistics(parts[2])[3]) and got["c"].valid_count == 0 and got["c"].mean is None


def test_points_as_a_stream(spark, tmp_path):
    rows = [("2024-01-01 00:00:10", -3.7, 40.4), ("2024-01-01 00:00:20", -3.7, 40.4), ("2024-01-01 00:05:00", 10.0, 50.0)]
    spark.createDataFrame(rows, "t string, lon double, lat double").coalesce(1).write.json(str(tmp_path / "in"))
    stream = spark.readStream.schema("t timestamp, lon double, lat double").json(str(tmp_path / "in"))
    counted = points.counts_by_cell(stream, 9, "t", "1 minute", "1 minute")
    q = counted.writeStream.format("memory").queryName("cells_seen").outputMode("complete").option("checkpointLocation", str(tmp_path / "state")).start()
    q.processAllAvailable()
    q.stop()
    got = {r.block: r.points for r in spark.table("cells_seen").collect()}
    assert got == {geometry.encode_tile(*geometry.tile_of((-3.7, 40.4), 9), 9): 2, geometry.encode_tile(*geometry.tile_of((10.0, 50.0), 9), 9): 1}


def test_bad_layout_raises(spark):
    with pytest.raises(Exception, match="unknown layout"):
        spark.range(1).select(bands.band(F.lit(bytearray(b"a")), 1, "Tiled")).collect()
    assert cells.HEADER | cells.MODE == 5188146770730811392
