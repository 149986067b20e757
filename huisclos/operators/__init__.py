"""Operators over document, span, vault and reply tables."""
