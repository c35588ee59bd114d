"""Column expressions: everything here maps columns to columns."""
