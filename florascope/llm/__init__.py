"""Operators on texts, names and co-occurrence for training-data pipelines."""
