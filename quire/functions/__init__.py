"""Column functions: text tests and rewrites, integer geometry, identities."""
