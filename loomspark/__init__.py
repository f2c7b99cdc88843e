"""Relational data synthesis, coherence and constraint analytics on PySpark."""
