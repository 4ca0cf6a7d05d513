"""Spatial tiling and region queries on PySpark."""
