"""Aggregations, file lifecycle and admission."""
