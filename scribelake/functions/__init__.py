"""Column functions and the few vectorized Python functions."""
