"""Operators for training-data pipelines.

Self-contained: nothing else in the library imports this package, and it
imports nothing from the rest of the library.
"""
