"""Column functions: text, HTML and vectors."""
