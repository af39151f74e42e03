"""Expressions: kernels, distances, special functions."""
