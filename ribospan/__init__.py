"""Spark-native operators for RNA-binding windows, variants, motifs and score tables."""

__version__ = "0.1.0"
