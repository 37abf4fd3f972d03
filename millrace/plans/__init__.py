"""Declarative pipelines: the operator registry and the document runner."""
