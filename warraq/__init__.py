"""Cleaning, repair and search of recognised text, most of all Arabic, as Spark expressions and joins."""
