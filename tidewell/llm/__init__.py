"""Operators of a training-data pipeline over the ``documents`` tables.

Nothing else in the library imports this subpackage. Column names that start
with ``__tw_`` are reserved for the operators' own intermediate columns; every
other column of an input may have any name.
"""
