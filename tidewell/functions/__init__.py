"""Scalar functions: columns in, a column out."""
