"""Terrain and reference-geography analytics on PySpark DataFrames."""
