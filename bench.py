"""Headline workloads: prints one JSON line with the seconds of each.

BENCH_SF_DIR (default /root/testdata/sf0.1) holds the tables, BENCH_CPUS the number of threads. The two band workloads read
1,000 tiles of 256 x 256 gzip-packed 32-bit floats, made once from the embeddings and written as a tile table beforehand.
Every workload runs once to warm up and then three times; the median counts.
"""

from __future__ import annotations

import json
import os
import shutil
import sys
import tempfile
import time
from statistics import median

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join([ROOT, os.environ.get("PYTHONPATH", "")])

import pyarrow as pa  # noqa: E402
from pyspark.sql import DataFrame, SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402
from pyspark.sql.types import BinaryType  # noqa: E402

from tilewright.functions import bands, cells, geometry  # noqa: E402
from tilewright.functions.register import register  # noqa: E402
from tilewright.operators import lookup  # noqa: E402
from tilewright.plans import fixtures  # noqa: E402
from tilewright.sources import tiles as source  # noqa: E402

TILES, SIDE, RUNS = 1000, 256, 3


@F.arrow_udf(BinaryType())
def large_tile(vectors: pa.Array) -> pa.Array:
    """A 256 x 256 tile of each vector, repeated and shifted so that rows differ."""
    import gzip

    import numpy as np

    out = []
    for v in vectors.to_pylist():
        base = np.resize(np.array(v, "<f4"), SIDE * SIDE)
        out.append(gzip.compress((base + np.arange(SIDE * SIDE, dtype="<f4") / 1e5).astype("<f4").tobytes(), 6))
    return pa.array(out, pa.binary())


def write_large_tiles(spark: SparkSession, sf_dir: str, path: str) -> None:
    rows = fixtures.table(spark, sf_dir, "embeddings")
    n = rows.count()
    more = rows.crossJoin(F.broadcast(spark.range(-(-TILES // n)).withColumnRenamed("id", "copy"))) if n < TILES else rows.withColumn("copy", F.lit(0))
    number = F.col("copy") * n + F.col("vec_id")
    tiles = more.where(number < TILES).select(cells.from_tile(number % 32, F.floor(number / 32), F.lit(9)).alias("block"), large_tile("embedding").alias("band_1"))
    document = {"version": "0.1.0", "compression": "gzip", "tiling": {"block_width": SIDE, "block_height": SIDE, "min_zoom": 9, "max_zoom": 9}, "bands": [{"name": "band_1", "type": "float32", "nodata": "NaN"}]}
    source.write_tiles(tiles.repartition(16), path, document)


def workloads(spark: SparkSession, sf_dir: str, path: str) -> dict[str, DataFrame]:
    raster = source.read_raster_parquet(spark, path)
    raster.createOrReplaceTempView("bench_tiles")
    band = bands.described(raster, "band_1")
    tiles = source.read_tiles(raster).select("block", band.alias("band")).limit(TILES)
    # the tables are one small file each: their rows are dealt to all cores before work that costs more than reading
    cores = spark.sparkContext.defaultParallelism
    points = fixtures.points(spark, sf_dir).repartition(cores)
    lines = fixtures.table(spark, sf_dir, "lineitem")
    lon = (F.col("l_orderkey") * 7919 % 359000) / 1000 - 179.4997
    lat = (F.col("l_partkey") * 104729 % 169000) / 1000 - 84.4997
    located = lines.select(cells.from_lonlat(lon, lat, F.lit(14)).alias("cell"), "l_quantity")
    ring = "POLYGON((-180 85, -160 85, -160 84, -180 84, -180 85))"
    return {
        "band_native": tiles.select(F.sum(F.size(bands.native("band", "float32")))),
        "band_native_sql": spark.sql(f"SELECT sum(size(p)) FROM (SELECT raquet_band_native_float32(binary_to_raquet(band_1, '{SIDE}', 'Separated', 'float32', 'NaN', 'gzip')) AS p FROM bench_tiles WHERE block <> 0 LIMIT {TILES})"),
        "band_statistics": tiles.select(bands.statistics("band").alias("s")).agg(F.avg("s.mean"), F.sum("s.valid_count")),
        "points_value": lookup.sample_points(points, fixtures.banded(spark, sf_dir).select("block", "floats"), fixtures.grid_zoom(spark, sf_dir), "floats").agg(F.sum("value")),
        "lonlat_rollup": located.groupBy(cells.to_parent("cell", F.lit(6)).alias("parent")).agg(F.sum("l_quantity").alias("q")).agg(F.count("parent"), F.sum("q")),
        "kring_explode": fixtures.cell_rows(spark, sf_dir).repartition(cores).select(F.explode(cells.kring("cell", 2)).alias("c")).agg(F.count("c"), F.bit_xor("c")),
        "read_at": source.read_at(raster, ring).select(F.sum(F.length("band_1"))),
        "polyfill": points.select(F.explode(geometry.polyfill(F.format_string("LINESTRING(%s %s, %s %s)", "lon", "lat", F.col("lon") / 2, F.col("lat") + 5), F.lit(8))).alias("c")).agg(F.count("c")),
    }


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count()))
    conf = {
        "spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "8g", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false",
        "spark.sql.session.timeZone": "UTC", "spark.sql.execution.arrow.maxRecordsPerBatch": "64",
    }
    spark = SparkSession.builder.master(f"local[{cpus}]").config(map=conf).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    folder = tempfile.mkdtemp(prefix="tilewright-bench-")
    try:
        register(spark)
        write_large_tiles(spark, sf_dir, f"{folder}/tiles")
        runs: dict[str, list[float]] = {}
        for _ in range(RUNS + 1):
            # planned anew each time: a frame that was collected keeps the results of its shuffles
            for name, df in workloads(spark, sf_dir, f"{folder}/tiles").items():
                began = time.perf_counter()
                df.collect()
                runs.setdefault(name, []).append(time.perf_counter() - began)
        seconds = {name: round(median(x[1:]), 4) for name, x in runs.items()}
    finally:
        shutil.rmtree(folder, ignore_errors=True)
    print(json.dumps({"metric": "headline workloads, total", "value": round(sum(seconds.values()), 4), "unit": "sec", "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
