"""Relational operators: deduplication, grouping, lookups, ranking, facets."""
