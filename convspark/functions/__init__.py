"""Column expressions (scalar functions X1-X29). Each takes and returns Columns."""
