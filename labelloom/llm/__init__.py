"""Operators for training-data pipelines on text corpora."""
