"""Readers and writers of corpora, seeds, knowledge bases and results."""
