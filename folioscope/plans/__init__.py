"""Compositions of operators: ingest, retrieval, evaluation, figure tables."""
