"""Operators on DataFrames: layout, structure, chunking, retrieval, context, history, OCR planning, limits."""
