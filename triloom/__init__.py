"""Triloom: a Spark-native engine for code-graph triples, signatures and clone search."""

__version__ = "0.1.0"
