"""Relational operators of the archive index, each a function of DataFrames."""
