"""Relational and numerical operators over points."""
