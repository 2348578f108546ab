"""Column functions: text, vectors, ids."""
