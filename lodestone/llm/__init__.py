"""Operators on training data: parse checks, top N, grouping of matches, source filters, leakage, mixing and repair."""
