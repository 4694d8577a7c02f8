"""Column functions: text, cells, statistics."""
