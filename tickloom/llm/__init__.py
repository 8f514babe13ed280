"""Operators for large training corpora: each module is one operator on DataFrames."""
