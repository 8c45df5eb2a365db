"""Column expressions: null rules, text and dates."""
