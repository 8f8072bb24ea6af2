"""Operators of a training-data pipeline over text, vector and page tables.

Every operator is a module with functions on DataFrames; the thin registered
queries and their SQL are in the ``*_queries`` modules.
"""
