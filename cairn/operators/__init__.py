"""Operators over DataFrames; all stay lazy unless their docstring says otherwise."""
