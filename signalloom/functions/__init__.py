"""Scalar functions: columns in, a column out, built from Spark expressions."""
