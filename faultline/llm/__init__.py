"""Operators of a training-data pipeline, each built from Spark jobs.

Nothing else in the library imports this subpackage; the registered queries
(``queries.py``) are added by ``__spark_entry__.py`` when it can be imported.
"""
