"""Operators on matrices, variants and pairs."""
