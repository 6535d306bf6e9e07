"""Operators: DataFrames in, DataFrame out, lazy unless the docstring says otherwise."""
