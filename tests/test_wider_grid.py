"""Raster queries over more embeddings than the SQL's grid has cells: against their SQL with the next grid's columns and zoom.

The SQL as given keeps to 64 columns of zoom 6. Past 4,096 ids its numbers repeat, so it tells nothing about the rows there.
"""

import os

import duckdb
import pytest

import __spark_entry__ as entry_point
from tilewright.plans import fixtures as fx

NAMES = (
    "band_descriptor decode decompress file_at file_block file_ddl file_statistics geometry_join intersects_join native_float32 native_int16 native_types pixel "
    "pyramid_rollup read_at tiles_inside file_metadata statistics value sample_points zones_by_geometry"
).split()
#: What of the SQL depends on the grid, at zoom 6 and at zoom 7; the last ones are a cell of zoom 4 and one of zoom 2.
WIDER = [
    ("vec_id % 64", "vec_id % 128"), ("vec_id // 64", "vec_id // 128"), ("(6)::BIGINT", "(7)::BIGINT"), ("1::BIGINT << 6)", "1::BIGINT << 7)"), ("* 64", "* 128"), ("6::INT AS max_zoom", "7::INT AS max_zoom"),
    ("128 // 4", "128 // 8"), ("BETWEEN 16 AND 31", "BETWEEN 32 AND 63"), ("128 < 16", "128 < 32"),
]


@pytest.fixture(scope="module")
def tables(spark, sf, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    ids = sorted({128 * y + x for y in range(20) for x in range(24)} | {128 * y + x for y in range(0, 128, 5) for x in range(3, 128, 11)} | {197, 4095, 4096, 4293, 8191, 8192, 16383})
    spark.createDataFrame([(i, i % 3, [(i * 31 % 97) / 7 + j / 4 for j in range(64)]) for i in ids], "vec_id long, label int, embedding array<float>").coalesce(1).write.parquet(f"{path}/embeddings.parquet")
    os.symlink(f"{sf}/orders.parquet", f"{path}/orders.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW orders AS SELECT * FROM '{path}/orders.parquet'")
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{path}/embeddings.parquet/*.parquet'")
    return path, con


@pytest.mark.parametrize("name", NAMES)
def test_past_the_grid(spark, tables, name):
    path, con = tables
    text = entry_point.oracle_sql()[name]
    for old, new in WIDER:
        text = text.replace(old, new)
    got = entry_point.queries()[name](spark, path)
    cols = sorted(got.columns)
    want = con.execute(f"SELECT {', '.join(cols)} FROM ({text})").fetchall()
    shown = lambda rows: sorted((tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in rows), key=repr)
    assert want and shown(map(tuple, got.select(*cols).collect())) == shown(want)


def test_the_sql_gives_one_number_to_two_tiles():
    number = lambda i: duckdb.sql(f"SELECT {fx.cell_sql(str(i % 64), str(i // 64), '6')}").fetchall()[0][0]
    assert number(0) == number(4096) and number(197) == number(4293)  # two tiles at one place
    assert number(8192) >> 52 & 31 == 14  # a zoom without this tile
