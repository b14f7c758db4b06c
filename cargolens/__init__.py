"""Audit machine-learning artifacts and text corpora at scale with Spark DataFrames."""

__version__ = "0.1.0"
