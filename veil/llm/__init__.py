"""Operators of a training-data pipeline: dedup, token counts, packing, extraction, scoring, search."""
