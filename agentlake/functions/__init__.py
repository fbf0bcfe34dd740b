"""Column builders: every function takes and returns Columns."""
