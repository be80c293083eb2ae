"""Column and table expressions."""
