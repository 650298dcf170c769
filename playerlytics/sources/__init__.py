"""Readers, writers and schemas of event collections and rollup tables."""
