"""Inkwell: document-intelligence analytics expressed as Spark plans."""
