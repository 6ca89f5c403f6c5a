"""Relational operators: extraction, matching, scoring, evaluation, loading."""
