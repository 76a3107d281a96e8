"""Readers and writers of rasters and features, and clients of public map services."""
