"""Delimited text and Parquet in, Parquet and reporting CSV out."""
