"""Operators of a large-scale training-data pipeline. Nothing else in the library imports this package.

Each module holds one operator with its general interface; ``queries`` registers one thin query per
operator over the given tables.
"""
