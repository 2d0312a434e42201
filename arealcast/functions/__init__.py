"""Column expressions: time, scalar and identifier functions."""
