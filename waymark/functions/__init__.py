"""Column expressions: geometry, names, scalar helpers."""
