"""Readers and parsers for knowledge files, pages and tables."""
