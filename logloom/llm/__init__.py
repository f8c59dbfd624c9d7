"""Operators for building training data from document tables.

Nothing else in the library imports this subpackage.
"""
