"""Maintenance of query results under streams of new edges."""
