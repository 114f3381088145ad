"""Operators for preparing text, vectors and web pages for model training.

Nothing else in the package imports this subpackage; ``registry`` lists its
queries for the driver.
"""
