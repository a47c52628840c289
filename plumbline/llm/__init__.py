"""Operators of a training-data pipeline over tables of documents and pages.

Each module holds one operator; ``queries`` registers the thin digest queries.
Nothing else in the library imports this subpackage.
"""
