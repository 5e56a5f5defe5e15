"""Column expressions: URLs, routes, text."""
