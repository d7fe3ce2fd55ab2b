"""Readers, writers and the logical tables the operators work on."""
