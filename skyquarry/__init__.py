"""Skyquarry: raster, terrain and catalog analytics expressed as Spark plans."""
