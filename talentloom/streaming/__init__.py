"""Continuous intake of documents."""
