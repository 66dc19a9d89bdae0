"""Spark-native preparation, layout and accounting of multimodal conversation data."""
