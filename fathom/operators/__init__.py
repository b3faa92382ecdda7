"""Operators over corpus and graph tables; all take and return DataFrames."""
