"""Operators of a training-data pipeline; `queries` registers one query each."""
