"""Operators for large-scale training-data pipelines.

Nothing else in the library imports this subpackage.  ``registry.QUERIES``
and ``registry.ORACLE`` hold its queries and their DuckDB SQL.
"""
