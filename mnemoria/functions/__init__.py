"""Column expressions: text, identity, time and vectors."""
