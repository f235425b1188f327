"""Spark-native analytics over building outlines, laser points and their quality."""
