"""Column functions: text, vectors, URLs, JSON."""
