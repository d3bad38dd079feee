"""Scalar functions of the archive engine, as Column expressions."""
