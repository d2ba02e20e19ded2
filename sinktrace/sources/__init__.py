"""Readers of archives, source trees, reports, mapper files and route tables."""
