"""Column expressions: no Python runs in them."""
