"""Readers: event catalogs, boundaries, focal catalogs, predictions, feeds."""
