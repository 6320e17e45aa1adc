"""Whole chains built from the operators."""
