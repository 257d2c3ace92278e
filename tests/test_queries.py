"""Every query of the entry point against its SQL in DuckDB, and the contract around them."""

import duckdb
import pytest

import __spark_entry__ as entry_point
from pyspark.sql import functions as F

from tilewright.functions import cells, geometry
from tilewright.operators import lookup
from tilewright.plans import queries

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def shown(df):
    cols = sorted(df.columns)
    return list(tuple(round(v, 9) if isinstance(v, float) and v == v else None if v is None or v != v else v for v in row) for row in df[cols].astype(object).where(df[cols].notna(), None).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(entry_point.oracle_sql()))
def test_query_equals_its_sql(spark, sf, duck, name):
    got, want = entry_point.queries()[name](spark, sf).toPandas(), duck.execute(entry_point.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    key = lambda rows: sorted(rows, key=repr)
    assert key(shown(got)) == key(shown(want))


def test_contract(spark):
    assert set(entry_point.oracle_sql()) <= set(entry_point.queries())
    df = entry_point.entry(spark)
    assert df.count() > 0 and df.columns[0] == "block"


def orders_of(spark, sf):
    return {r[0] for r in spark.read.parquet(f"{sf}/orders.parquet").select("o_orderkey").collect()}


@pytest.mark.parametrize("name", ["polyfill_rect", "polyfill_cover", "bbox_cells", "polyfill_line", "polyfill_triangle", "polyfill_hole"])
def test_every_order_has_its_box(spark, sf, name):
    assert {r[0] for r in entry_point.queries()[name](spark, sf).select("k").distinct().collect()} == orders_of(spark, sf)


def test_boxes_reach_the_edges(spark, sf):
    found = queries.rectangles(spark, sf).selectExpr("max(east)", "max(north)", "count(*)").first()
    assert tuple(found) == (queries.EDGE_LON, queries.EDGE_LAT, len(orders_of(spark, sf)))


@pytest.mark.parametrize(("name", "levels"), [("children", 1), ("children_at", 2)])
def test_cells_of_all_zooms_have_children(spark, sf, name, levels):
    rows = entry_point.queries()[name](spark, sf)
    assert {r[0] for r in rows.select("k").distinct().collect()} == orders_of(spark, sf)
    zooms = {r.z for r in spark.read.parquet(f"{sf}/orders.parquet").selectExpr("1 + o_orderkey % 20 AS z").distinct().collect()}
    assert {r[0] for r in rows.select(cells.resolution("child")).distinct().collect()} == {z + levels for z in zooms}
    assert len(zooms) > 10


def test_file_filters_reach_the_scan(spark, sf):
    """Filters on cells are pushed down, columns are pruned, and row groups without the cell are not read."""
    path = queries.tile_file(spark, sf)
    df = queries.source.read_raster_parquet(spark, path)
    one = geometry.encode_tile(5, 3, 6)
    plan = df.where(F.col("block") == one).select("block", "band_1")._jdf.queryExecution().executedPlan().toString()
    assert f"EqualTo(block,{one})" in plan and "ReadSchema: struct<block:bigint,band_1:binary>" in plan
    near = queries.source.read_at(df, queries.READ_AT).select("block")
    plan = near._jdf.queryExecution().executedPlan().toString()
    assert "In(block" in plan.replace("PushedFilters: [", "") and "ReadSchema: struct<block:bigint>" in plan
    scan = df.where(F.col("block") == one).select("block", "band_1")
    assert scan.count() == 1
    leaf = scan._jdf.queryExecution().executedPlan()
    while leaf.children().size():
        leaf = leaf.children().head()
    scan._jdf.queryExecution().executedPlan().executeCollectPublic()
    read = leaf.metrics().apply("numOutputRows").value()
    assert 0 < read < spark.read.parquet(path).count() / 2, read


def test_a_hot_tile_is_dealt_to_several_tasks(spark, sf, monkeypatch):
    want = sorted(map(tuple, queries.QUERIES["sample_points"](spark, sf).collect()))
    monkeypatch.setattr(lookup, "TASK_POINTS", 1)
    assert sorted(map(tuple, queries.QUERIES["sample_points"](spark, sf).collect())) == want
    monkeypatch.setattr(lookup, "HOT_TILES", 0)
    assert sorted(map(tuple, queries.QUERIES["sample_points"](spark, sf).collect())) == want


GRID_QUERIES = "statistics statistics_no_data statistics_sql band_descriptor decompress pixel read_tiles"


@pytest.fixture(scope="module")
def wide(spark, tmp_path_factory):
    """Embeddings with ids on both sides of 4,096, the cells of the grid at zoom 6."""
    path = str(tmp_path_factory.mktemp("wide"))
    rows = [(i, i % 3, [float(i % 97 + j) for j in range(64)]) for i in (0, 1, 4095, 4096, 4097, 8191, 16383, 16384, 70000)]
    spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").write.parquet(f"{path}/embeddings.parquet")
    return path


@pytest.mark.parametrize("name", GRID_QUERIES.split())
def test_no_embedding_is_lost_past_the_grid(spark, wide, name):
    assert entry_point.queries()[name](spark, wide).select("block").distinct().count() == 9


def test_zonal_stats_past_the_grid_equal_their_sql(spark, wide):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{wide}/embeddings.parquet/*.parquet'")
    got, want = entry_point.queries()["zonal_stats"](spark, wide).toPandas(), con.execute(entry_point.oracle_sql()["zonal_stats"]).df()
    assert sorted(shown(got)) == sorted(shown(want))


def test_an_embedding_without_a_cell_is_an_error(spark, tmp_path):
    spark.createDataFrame([(-1, 0, [0.5] * 64)], "vec_id long, label int, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    with pytest.raises(Exception, match="has no cell"):
        entry_point.queries()["statistics"](spark, str(tmp_path)).collect()
