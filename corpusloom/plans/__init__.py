"""Complete queries built from the operators, with their SQL twins."""
