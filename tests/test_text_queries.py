"""Queries that unnest the numbers of a text make and read the text once."""

import __spark_entry__ as entry_point


def above_generate(df):
    """The optimized plan's nodes above the one that unnests, and how often the scan is filtered."""
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    above, below = plan.split("Generate", 1)
    return above, below.count("Filter")


def test_wkt_is_made_once_for_a_text(spark, sf):
    above, filters = above_generate(entry_point.queries()["wkt"](spark, sf))
    assert "POLYGON" not in above and "transform" not in above and filters == 0


def test_geojson_is_made_once_for_a_text(spark, sf):
    above, filters = above_generate(entry_point.queries()["geojson"](spark, sf))
    assert "from_json" not in above and "transform" not in above and filters == 0
