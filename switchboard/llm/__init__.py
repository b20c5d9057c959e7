"""Operators of a training-data pipeline: cleaning, deduplication, mixing and encoding of a corpus."""
