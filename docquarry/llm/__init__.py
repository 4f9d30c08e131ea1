"""Operators for large training-data pipelines.

Nothing else in the library imports this subpackage; ``queries`` and ``oracle_sql`` are read by the entry module if it can be imported.
"""
