"""Gaussian-process analytics over point tables, declared as DataFrame plans."""

__version__ = "0.1.0"
