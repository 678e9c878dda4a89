"""Lectern: textbook retrieval, knowledge-graph and text-processing operators as PySpark plans."""
