"""Spatial point data and voxel grids on Spark DataFrames."""

__version__ = "0.1.0"
