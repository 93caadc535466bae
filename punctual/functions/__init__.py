"""Column expressions and small DataFrame building blocks."""
