"""Sojourn: episode analytics (stays, stints, paths, occupancy) as lazy Spark DataFrames."""
