"""Micro-batch pseudonymization over a stream of documents."""
