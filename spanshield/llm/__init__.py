"""Operators for training-data pipelines: mixing, filtering, deduplication, packing, search,
formatting, scoring. Nothing else in the library imports this subpackage."""
