"""Column expressions: no shuffle, no Python, usable inside any select."""
