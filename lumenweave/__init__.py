"""Spark-native analytics for imaging-spectroscopy rasters and their ground truth."""
