"""Operators for preparing training text: quality, duplicates, contamination, tokens, archives.

Every operator is a function on DataFrames with its own general interface; ``queries`` holds
the thin registered queries and ``sql`` their SQL twins.
"""
