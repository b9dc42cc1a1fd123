"""Scalar helpers: every one takes and returns Columns, none is a Python UDF."""
