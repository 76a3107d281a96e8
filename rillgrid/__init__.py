"""Raster, watershed and hazard analytics expressed as Spark DataFrame plans."""
