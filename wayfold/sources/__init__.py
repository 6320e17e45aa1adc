"""Readers, the dataset store, and the tables the registered queries start from."""
