"""Column expressions and Arrow functions for text, phrases and vectors."""
