"""Operators on tables: footnote repair and page search."""
