"""Operators for preparing large training corpora.

Each module holds one operator with a general interface and the query that applies it to the test tables.
Nothing else in the library imports this subpackage.
"""
