"""Operators of a training-data pipeline: filtering, deduplication, scoring, extraction, formatting and packing."""
