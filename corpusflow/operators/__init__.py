"""Relational, text, model and graph operators."""
