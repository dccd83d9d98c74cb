"""Scalar building blocks: Column expressions and Arrow-backed UDFs."""
