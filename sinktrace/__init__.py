"""Spark jobs for code-reachability findings and training-corpus preparation."""
