"""Operators for preparing training text: search, scoring, dedup, packing, encoding and archives.

Every operator takes and returns DataFrames; ``queries`` wires each to its table.
"""
