"""Whole-genome plans."""
