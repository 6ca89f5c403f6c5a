"""Whole pipelines: bootstrapping, evaluation and the registered queries."""
