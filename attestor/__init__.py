"""Structured extraction, validation and corpus preparation on Spark DataFrames."""
