"""Column builders: text, vectors, metrics, hash order."""
