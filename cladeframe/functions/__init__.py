"""Column expressions: ranks, scores, formats."""
