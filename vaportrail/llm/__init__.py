"""Operators of a training-data pipeline: text tables in, per-document decisions out."""
