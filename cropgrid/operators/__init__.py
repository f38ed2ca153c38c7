"""Reusable relational operators: quantiles, nearest neighbours, merges, quality, metrics."""
