"""Hierarchy, spatial, voxel and time-series analytics on Spark DataFrames."""
