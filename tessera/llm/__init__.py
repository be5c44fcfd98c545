"""Operators of a training-data pipeline, one module per operator.

Nothing else in the library imports this package; ``queries`` registers one query per
operator and ``__spark_entry__`` adds them when the package is there.
"""
