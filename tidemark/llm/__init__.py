"""Operators of a training-data pipeline: packing, scoring, extraction, mixing, encoding, near copies, search.

Nothing outside this subpackage imports it. ``queries`` holds the registered queries.
"""
