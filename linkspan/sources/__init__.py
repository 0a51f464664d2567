"""Readers of pair tables, variant lists, square matrices, keep lists and stored matrices."""
