"""Column functions, global order and intermediate tables."""
