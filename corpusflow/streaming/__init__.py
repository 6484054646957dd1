"""Incremental counterparts."""
