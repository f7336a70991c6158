"""Relational operators: merging, apportioning, spatial joins, graphs and scores."""
