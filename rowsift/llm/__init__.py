"""Operators of a large training-data pipeline (text, vectors, conversations).

Nothing outside this subpackage imports it; it may import general helpers of the library.
Each module is one operator with a general interface; ``queries`` holds the thin registered
queries that derive the contract columns from them.
"""
