"""Operators on DataFrames of points, voxels, pixels, meshes, graphs and sequences."""
