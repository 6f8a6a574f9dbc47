"""Operators that large training-data pipelines need.

Nothing else in the library imports this subpackage; it can be removed whole.
"""
