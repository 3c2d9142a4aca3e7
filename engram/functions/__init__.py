"""Column builders: text, scores, vectors, and the fixed word lists they use."""
