"""Iterative vertex programs composed from the operators."""
