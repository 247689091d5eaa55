"""Operators for large training-data pipelines.

Nothing outside this subpackage imports it; ``queries.queries()`` and
``queries.oracle_sql()`` are what the repository's entry file picks up.
"""
