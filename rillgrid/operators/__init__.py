"""Operators over rasters and stream networks."""
