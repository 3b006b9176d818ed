"""Functions over archive tables."""
