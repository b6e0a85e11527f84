"""Column expressions: no jobs, no Python in the row path."""
