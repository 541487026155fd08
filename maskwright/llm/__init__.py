"""Operators for large text-training corpora.

Nothing outside this subpackage imports it; ``queries.py`` here holds its
registered queries and SQL.
"""
