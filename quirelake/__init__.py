"""Spark-native analytics for book-scale prose: parsing, segmentation, attribution, timelines, batching."""
