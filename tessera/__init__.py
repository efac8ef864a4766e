"""Tessera: raster containers and compressed byte streams as Spark tables."""
