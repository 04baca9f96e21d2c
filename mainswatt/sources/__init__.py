"""Sources of sample tables."""
