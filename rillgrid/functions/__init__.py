"""Column expressions: units, slopes, NoData, classes and hazard models."""
