"""Relational operators: blocking, matching, refining, graphs, finance, data cleaning."""
