"""Readers and writers: documents, web pages, blocks, chunk and vector tables."""
