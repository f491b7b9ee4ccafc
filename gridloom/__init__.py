"""Batch record normalisation, matching and publish planning on Spark DataFrames."""
