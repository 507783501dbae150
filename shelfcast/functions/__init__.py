"""Column expressions: no joins, no windows, no actions."""
