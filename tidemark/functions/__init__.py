"""Column functions and window kernels."""
