"""Readers, writers and schema-level catalogs."""
