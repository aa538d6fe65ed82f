"""Incremental versions of the operators."""
