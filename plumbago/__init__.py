"""Incremental and semantic analytics expressed as Spark DataFrames."""
