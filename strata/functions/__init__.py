"""Column functions and Python functions."""
