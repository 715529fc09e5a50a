"""Operators for preparing training data; the core does not import this package."""
