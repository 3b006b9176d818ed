"""Operators over archive tables."""
