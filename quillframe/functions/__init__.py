"""Column functions over text, tokens, lines and paths."""
