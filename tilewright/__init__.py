"""tilewright: raster tiles and cell mathematics on Apache Spark."""
