"""Operators that large training-data pipelines need."""
