"""Operators of ingestion, search, maintenance and evaluation, as functions of DataFrames."""
