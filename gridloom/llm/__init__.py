"""Operators of a training-data pipeline: filtering, deduplication, packing, tokens, chat."""
