"""Column functions: built-in expressions only."""
