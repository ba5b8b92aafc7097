"""Column expressions: text, HTML, dynamic JSON values and vectors."""
