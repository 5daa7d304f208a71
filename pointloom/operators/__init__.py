"""Operators: DataFrame in, DataFrame out; every table carries scan_id."""
