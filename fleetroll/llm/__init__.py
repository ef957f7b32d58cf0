"""Operators for preparing training data: extraction, search, token files, deduplication, mixing, packing, formatting.

Nothing outside this folder imports it. Every operator is a function from DataFrames to DataFrames; the registered queries
in ``queries`` derive their digest columns from the operators' own results.
"""
