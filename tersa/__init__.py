"""Reversible context compression for large tables of agent text, on Spark."""

__version__ = "0.1.0"
