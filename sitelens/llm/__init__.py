"""Operators of a training-data pipeline over ``documents``-like tables.

Nothing else in the library imports this subpackage.  One module per operator,
``queries.py`` registers the ``opN_*`` queries and their SQL.
"""
