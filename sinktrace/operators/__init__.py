"""Operators on candidates, findings and call graphs."""
