"""Operators of a training-data pipeline, each with a query over whole tables."""
