"""Column functions: patterns and text."""
