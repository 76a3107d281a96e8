"""Hazard over streams of storms."""
