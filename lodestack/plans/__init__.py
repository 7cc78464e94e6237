"""Composed plans: ingest, answer, and the catalogue of queries with their SQL."""
