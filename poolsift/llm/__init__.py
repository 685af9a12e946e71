"""Operators of a training-data pipeline: deduplication, filtering, mixing,
placement, packing and search over document tables.

Nothing else in the library imports this subpackage.
"""
