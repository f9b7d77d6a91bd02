"""Quillspark: document-corpus analytics as lazy PySpark plans."""
