"""Operators on logs, progress and job events."""
