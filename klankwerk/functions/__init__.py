"""Column functions: text, paths, vectors, tokens and training mathematics."""
