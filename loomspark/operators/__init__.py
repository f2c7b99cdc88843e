"""Operators over DataFrames: key sampling, generation, coherence, validation and statistics."""
