"""Derived corpus, query registry and the SQL to compare with."""
