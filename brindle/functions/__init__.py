"""Scalar functions over columns and the reading of plain values as column types."""
