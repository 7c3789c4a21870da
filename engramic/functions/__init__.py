"""Column functions: numbers, vectors, scores."""
