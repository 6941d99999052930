"""Operators for large text and code collections; nothing else in the library imports this subpackage."""
