"""Operators for large-scale training-data pipelines, each a set of Spark jobs over tables of texts."""
