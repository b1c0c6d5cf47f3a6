"""Strandloom: a PySpark-native engine for layered networks and record pipelines."""

__version__ = "0.1.0"
