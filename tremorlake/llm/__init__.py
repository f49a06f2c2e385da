"""Operators for large-scale training-data pipelines: packing, dedup, sharding, scoring, decontamination."""
