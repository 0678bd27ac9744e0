"""Annotations and statistics that are built from column expressions."""
