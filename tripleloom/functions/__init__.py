"""Column functions and fits."""
