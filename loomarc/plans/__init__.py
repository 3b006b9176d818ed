"""Plans over archive tables."""
