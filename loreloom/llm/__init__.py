"""Operators for training-data pipelines: one module per operator.

Nothing outside this subpackage imports it.  ``queries`` registers the queries.
"""
