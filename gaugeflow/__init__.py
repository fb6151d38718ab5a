"""Spark-native analytics for measurement-grade capture data: series, clouds, meshes, gates, comparisons and state as DataFrames."""
