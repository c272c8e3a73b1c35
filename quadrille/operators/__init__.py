"""Relational and graph operators on DataFrames."""
