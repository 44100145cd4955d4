"""Operators for training-data pipelines: tokens, languages, quality, mixing, near copies."""
