"""Column expressions, all on built-in functions."""
