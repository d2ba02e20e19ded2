"""Jobs and the query catalogue over the standard tables."""
