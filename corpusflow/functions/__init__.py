"""Column expressions and lexicons."""
