"""Operators for large training-data pipelines.

Nothing else in the library imports this subpackage; ``queries`` holds the
driver-facing query table and its SQL twins.
"""
