"""Operators for training-data pipelines (packing, chat, token files, joins, filters)."""
