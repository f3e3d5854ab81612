"""Palimpsest: a PySpark-native analytics engine for revision archives."""

__version__ = "0.1.0"
