"""Operators for large-scale training-data pipelines.

Nothing else in the library imports this subpackage. `queries.QUERIES` and
`queries.ORACLE` hold what `__spark_entry__.py` registers.
"""
