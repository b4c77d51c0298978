"""Relational and text operators; every function takes and returns DataFrames."""
