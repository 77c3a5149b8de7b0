"""Column expressions: no job runs here, every function maps columns to a column."""
