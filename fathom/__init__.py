"""Fathom: a PySpark-native engine for code-knowledge graphs and document corpora."""

__version__ = "0.1.0"
