"""Column functions of text and vectors."""
