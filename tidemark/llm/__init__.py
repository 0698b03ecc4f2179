"""Operators for training-data pipelines: record linkage at scale and text corpora."""
