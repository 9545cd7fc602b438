"""Relational, ranking, resampling and routing operators over DataFrames."""
