"""Column expressions: counter-based randomness and value generators."""
