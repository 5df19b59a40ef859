"""Column functions: each takes columns (or their names) and returns a column."""
