"""Column functions: no shuffle, no Python worker."""
