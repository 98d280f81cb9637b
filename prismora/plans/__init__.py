"""Faceted queries as declarative plans."""
