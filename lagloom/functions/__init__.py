"""Column functions and fixed tables."""
