"""Operational tables and event streams to labelled, scored feature tables, on Spark."""

__version__ = "0.1.0"
