"""Geospatial coverage and routing on PySpark."""
