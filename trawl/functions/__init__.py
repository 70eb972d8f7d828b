"""Column functions: text, code, paths, vectors."""
