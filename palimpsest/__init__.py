"""Corpus analytics on Spark: DataFrame-first operators over document tables."""
